"""Synthetic clauses from the order lines: one SQL text that Spark and other engines run alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _case(expr: str, values: tuple[str, ...]) -> str:
    return "CASE " + expr + "".join(f" WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1])) + f" ELSE '{values[-1]}' END"


SYNTH_SQL = f"""
SELECT concat('ord_', l_orderkey) AS document_id, rn, concat('ord_', l_orderkey, '_clause_', lpad(concat('', rn), 4, '0')) AS clause_id,
  concat({_case("l_linenumber % 4", ("", "", "", "(a) "))}, 'The ',
    {_case("l_suppkey % 8", ("Supplier", "Customer", "Company", "Employee", "Contractor", "Licensor", "Licensee", "Party"))}, ' ',
    {_case("(l_partkey + l_linenumber) % 8", ("shall", "shall not", "may", "must", "may not", "is required to", "will", "means"))}, ' ',
    {_case("l_partkey % 5", ("deliver the report", "pay the invoice", "disclose confidential information", "provide the services", "terminate the agreement"))},
    ' within ', 1 + (l_linenumber % 7) * 5, ' ', {_case("l_suppkey % 4", ("days", "months", "business days", "hours"))},
    {_case("CAST(l_quantity AS INT) % 7", (" if the payment is delayed", " unless notice is given", " provided that consent is granted", " subject to approval", "", "", ""))}, '.') AS text
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn FROM lineitem) numbered
"""


def _over_lineitem(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """sql over the table's files, without a view of that name in the session."""
    return spark.sql(sql.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def synth_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, rn, clause_id, text."""
    return _over_lineitem(spark, sf_dir, SYNTH_SQL)


DRAFT_SQL = f"""
SELECT concat('ord_', l_orderkey) AS document_id, rn, concat('ord_', l_orderkey, '_draft_', lpad(concat('', rn), 4, '0')) AS clause_id,
  concat({_case("l_linenumber % 5", ("In addition, ", "Notwithstanding the foregoing, ", "", "For the avoidance of doubt, ", "On behalf of it "))}, 'the ',
    {_case("l_suppkey % 8", ("Receiving Party", "Disclosing Party", "Buyer", "Seller", "vendor", "Customer", "employer", "contractors"))}, ' ',
    {_case("(l_partkey + l_linenumber) % 9", ("shall", "shall not", "may", "must not", "will not", "cannot", "is required to", "are permitted to", "will"))}, ' ',
    {_case("l_partkey % 6", ("disclose any Confidential Information", "modifies the résumé of such façades", "paying the fee for all café transactions", "retain such notices and copies", "reverse-engineer the façade of it", "notify the other party"))},
    {_case("l_linenumber % 3", (" within 10 days", " until June 2030", ""))},
    {_case("CAST(l_quantity AS INT) % 7", (" if the payment is late", " only if approved, or not", " except that notice is given", " provided that consent is granted by the company", " subject to approval", "", " where applicable; otherwise none"))}, '.',
    {_case("l_partkey % 4", (" Fees are 12.5% of USD 1,200.50", " It takes 2.5 months", " No more than x$ 300 and 7 hours", ""))}) AS text
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn FROM lineitem) numbered
"""


def synth_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, rn, clause_id, text: clauses with accents, boilerplate, exceptions and amounts."""
    return _over_lineitem(spark, sf_dir, DRAFT_SQL)
