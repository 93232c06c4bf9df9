"""Deterministic case inputs made from the order tables, since no table holds case texts.

Each input exists twice: as a DataFrame and as SQL with the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What varies from case to case.
COURTS = ("Supreme Court of India", "Bombay High Court", "District Court", "National Green Tribunal", "Family Court", "Consumer Disputes Redressal Commission")
LEVELS = ("Supreme Court", "High Court", "District Court", "Tribunal", "Unknown")
MATTERS = (("AUTOMOBILE", "writ petition", "constitutional"), ("BUILDING", "criminal appeal", "criminal"), ("FURNITURE", "civil suit", "civil"), ("HOUSEHOLD", "income tax reference", "tax"), ("MACHINERY", "industrial dispute", "labour"))
ISSUE_TAIL = " applies to the disputed consignment of goods that was delivered late to the buyer"
FACT_TAIL = " was recorded by the surveyor at the port of delivery on the day of arrival of the ship"
LONG_RELIEF = "Set aside the order of the court below and award costs of the proceedings throughout"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(scan: DataFrame, key: str) -> DataFrame:
    """A table of fewer splits than cores, dealt out by key before heavy columns; larger tables stay as they lie."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(2 * cores, key) if scan.rdd.getNumPartitions() < cores else scan


def _choose(index: Column, values: tuple[str, ...]) -> Column:
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(index == i, v).otherwise(out)
    return out


def _sql_choose(index: str, values: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN {index} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _dealt(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", "o_orderstatus"), "k")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return orders.join(customer, "o_custkey").join(nation, "c_nationkey")


_SQL_BASE = "SELECT o_orderkey AS k, o_orderstatus, c_name, c_mktsegment, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"


def _matter(at: int) -> Column:
    out = F.lit(None).cast("string")
    for row in MATTERS:
        out = F.when(F.col("c_mktsegment") == row[0], row[at]).otherwise(out)
    return out


def _sql_matter(at: int) -> str:
    return "CASE c_mktsegment " + " ".join(f"WHEN '{m[0]}' THEN '{m[at]}'" for m in MATTERS) + " END"


def case_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, case_text): heading, parties, facts, statutes, a question, a prayer; some cases lack some of them."""
    k, text = F.col("k"), lambda *xs: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    n = lambda c: c.cast("string")
    some = lambda c, *xs: F.when(c, text(*xs)).otherwise("")
    body = text(
        some(k % 8 != 7, "IN THE ", _choose(k % 6, COURTS), "\n"), "Reference No. ", n(k), "\n",
        some(k % 13 != 0, F.col("c_name"), "\nversus\n", F.col("n_name"), " Traders ... Respondent\nCORAM: A. Kumar, J.\n\n"),
        some(k % 13 == 0, "Petitioner: ", F.col("c_name"), " versus another.\n\n"),
        "This ", _matter(1), " concerns a shipment of goods. ",
        some(k % 2 == 0, "The accused was seen near the market at 10 PM by two men. "), some(k % 3 == 0, "A complaint was lodged by the witness on the next morning. "),
        "The medical report was placed on the record before the hearing. ", some(k % 5 == 0, "This appeal is listed for final hearing on this day. "),
        some(k % 4 == 0, "The medical report was placed on the record before the hearing. "),
        some(k % 3 == 1, "The charge is under Section ", n(k % 500 + 1), " IPC, with Section ", n(k % 90 + 1), " CrPC. "), some(k % 17 == 0, "See also ", n(k % 400 + 100), " IPC IPC. "),
        some(k % 4 == 1, "Reliance is placed on the Carriage of Goods Act, ", n(k % 70 + 1930), ". "), some(k % 9 == 0, "The Indian Penal Code governs. "),
        some(k % 3 == 0, "Whether the order of the court below is valid in law? "), some(k % 6 == 0, "Whether the order of the court below is valid in law for shipment ", n(k), "? "),
        some(k % 10 == 0, "The issue is: the measure of loss on shipment ", n(k), "? "),
        some(F.col("o_orderstatus") == "O", "\n\nPrayer: that the order in case ", n(k), " be set aside.\n\nDated this day."),
    )
    return _base(spark, sf_dir).select(k.alias("case_id"), F.when(k % 11 == 0, "  \n ").otherwise(body).alias("case_text"))


def _sql_case_text() -> str:
    some = lambda c, *xs: f"(CASE WHEN {c} THEN {' || '.join(xs)} ELSE '' END)"
    nl, n = "chr(10)", lambda e: f"CAST({e} AS VARCHAR)"
    body = " || ".join([
        some("k % 8 <> 7", "'IN THE '", f"({_sql_choose('k % 6', COURTS)})", nl), "'Reference No. '", n("k"), nl,
        some("k % 13 <> 0", "c_name", nl, "'versus'", nl, "n_name", "' Traders ... Respondent'", nl, "'CORAM: A. Kumar, J.'", nl, nl),
        some("k % 13 = 0", "'Petitioner: '", "c_name", "' versus another.'", nl, nl),
        "'This '", f"({_sql_matter(1)})", "' concerns a shipment of goods. '",
        some("k % 2 = 0", "'The accused was seen near the market at 10 PM by two men. '"), some("k % 3 = 0", "'A complaint was lodged by the witness on the next morning. '"),
        "'The medical report was placed on the record before the hearing. '", some("k % 5 = 0", "'This appeal is listed for final hearing on this day. '"),
        some("k % 4 = 0", "'The medical report was placed on the record before the hearing. '"),
        some("k % 3 = 1", "'The charge is under Section '", n("k % 500 + 1"), "' IPC, with Section '", n("k % 90 + 1"), "' CrPC. '"), some("k % 17 = 0", "'See also '", n("k % 400 + 100"), "' IPC IPC. '"),
        some("k % 4 = 1", "'Reliance is placed on the Carriage of Goods Act, '", n("k % 70 + 1930"), "'. '"), some("k % 9 = 0", "'The Indian Penal Code governs. '"),
        some("k % 3 = 0", "'Whether the order of the court below is valid in law? '"), some("k % 6 = 0", "'Whether the order of the court below is valid in law for shipment '", n("k"), "'? '"),
        some("k % 10 = 0", "'The issue is: the measure of loss on shipment '", n("k"), "'? '"),
        some("o_orderstatus = 'O'", nl, nl, "'Prayer: that the order in case '", n("k"), "' be set aside.'", nl, nl, "'Dated this day.'"),
    ])
    return f"SELECT k AS case_id, CASE WHEN k % 11 = 0 THEN '  ' || chr(10) || ' ' ELSE {body} END AS case_text FROM ({_SQL_BASE})"


def case_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with every mix of lists, parties, relief, court and type."""
    k = F.col("k")

    def listed(n: Column, item) -> Column:
        return F.transform(F.filter(F.array(*[F.lit(i) for i in range(1, 7)]), lambda i: i <= n), item)

    n = lambda c: c.cast("string")
    return _base(spark, sf_dir).select(
        k.alias("case_id"), F.when(k % 7 != 0, F.col("c_name")).alias("petitioner"), F.when((k % 7 != 0) & (k % 5 != 0), F.concat(F.lit("M/s "), F.col("n_name"), F.lit(" Traders / Co"))).alias("respondent"),
        listed(k % 6, lambda i: F.concat(F.lit("Whether clause "), n(i), F.lit(" of order "), n(k), F.lit(ISSUE_TAIL))).alias("legal_issues"),
        listed(k % 4, lambda i: F.concat(F.lit("Section "), n((k * 7 + i) % 500), F.when(i == 2, " clause").otherwise(" IPC"))).alias("ipc_sections"),
        listed(F.floor(k / 4) % 4, lambda i: F.concat(F.lit("Carriage Act "), n(i), F.lit(", 195"), n(i))).alias("acts_referenced"),
        _choose(k % 6, LEVELS).alias("court_level"), _matter(2).alias("case_type"),
        listed(k % 5, lambda i: F.concat(F.lit("Fact "), n(i), F.lit(" of order "), n(k), F.lit(FACT_TAIL))).alias("key_facts"),
        F.when(k % 3 == 1, "Costs").when(k % 3 == 2, LONG_RELIEF).alias("relief_sought"),
    )


def _sql_case_profile() -> str:
    n = lambda e: f"CAST({e} AS VARCHAR)"
    listed = lambda m, item: f"list_transform(list_filter([1, 2, 3, 4, 5, 6], lambda i: i <= {m}), lambda i: {item})"
    return f"""SELECT k AS case_id, CASE WHEN k % 7 <> 0 THEN c_name END AS petitioner,
        CASE WHEN k % 7 <> 0 AND k % 5 <> 0 THEN 'M/s ' || n_name || ' Traders / Co' END AS respondent,
        {listed("k % 6", f"'Whether clause ' || {n('i')} || ' of order ' || {n('k')} || '{ISSUE_TAIL}'")} AS legal_issues,
        {listed("k % 4", f"'Section ' || {n('(k * 7 + i) % 500')} || CASE WHEN i = 2 THEN ' clause' ELSE ' IPC' END")} AS ipc_sections,
        {listed("(k // 4) % 4", f"'Carriage Act ' || {n('i')} || ', 195' || {n('i')}")} AS acts_referenced,
        {_sql_choose("k % 6", LEVELS)} AS court_level, {_sql_matter(2)} AS case_type,
        {listed("k % 5", f"'Fact ' || {n('i')} || ' of order ' || {n('k')} || '{FACT_TAIL}'")} AS key_facts,
        CASE WHEN k % 3 = 1 THEN 'Costs' WHEN k % 3 = 2 THEN '{LONG_RELIEF}' END AS relief_sought FROM ({_SQL_BASE})"""


def precedents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, rank, doc_id, title, court, date, similarity_score): none to four per case, some scores NULL or 0."""
    k, i = F.col("case_id"), F.col("rank")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.explode(F.array(*[F.lit(x) for x in range(1, 5)])).alias("rank")).filter(i <= k % 5)
    return rows.select(
        "case_id", "rank", ((k * 31 + i) % 1000).cast("string").alias("doc_id"),
        F.concat(F.lit("State v. Party "), ((k + i) % 97).cast("string"), F.when(i == 1, " in the matter of the long running dispute over the carriage of goods by sea").otherwise("")).alias("title"),
        F.when(i != 2, "High Court").alias("court"), F.when(i != 3, F.concat(F.lit("19"), (k % 40 + 50).cast("string"), F.lit("-01-0"), i.cast("string"))).alias("date"),
        F.when(k % 9 == 0, None).when(i == 3, F.lit(0.0)).otherwise(((k * 17 + i * 13) % 25) / 25.0).alias("similarity_score"),
    )


_SQL_PRECEDENTS = """SELECT k AS case_id, i AS rank, CAST((k * 31 + i) % 1000 AS VARCHAR) AS doc_id,
    'State v. Party ' || CAST((k + i) % 97 AS VARCHAR) || CASE WHEN i = 1 THEN ' in the matter of the long running dispute over the carriage of goods by sea' ELSE '' END AS title,
    CASE WHEN i <> 2 THEN 'High Court' END AS court, CASE WHEN i <> 3 THEN '19' || CAST(k % 40 + 50 AS VARCHAR) || '-01-0' || CAST(i AS VARCHAR) END AS date,
    CASE WHEN k % 9 = 0 THEN NULL WHEN i = 3 THEN 0.0::DOUBLE ELSE ((k * 17 + i * 13) % 25) / 25.0::DOUBLE END AS similarity_score
    FROM (SELECT o_orderkey AS k, unnest([1, 2, 3, 4]) AS i FROM orders) WHERE i <= k % 5"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, pos, entity_group, word, score) as a recogniser would give them."""
    k, i = F.col("case_id"), F.col("pos")
    groups = ("LAW", "ACT", "PERSON", "RESPONDENT", "ISSUE", "COURT", "ORG", "RELIEF", "ISSUE", "PETITIONER")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.explode(F.array(*[F.lit(x) for x in range(10)])).alias("pos")).filter(i < k % 11)
    group = _choose((k + i) % 10, groups)
    return rows.select("case_id", "pos", group.alias("entity_group"), F.concat(F.initcap(group), F.lit(" "), (k % 13 + i).cast("string"), F.when((k + i) % 10 == 5, F.concat(F.lit(" "), _choose(k % 6, COURTS))).otherwise("")).alias("word"), ((k * 3 + i * 7) % 20 / 20.0).alias("score"))


def _sql_entities() -> str:
    groups = ("LAW", "ACT", "PERSON", "RESPONDENT", "ISSUE", "COURT", "ORG", "RELIEF", "ISSUE", "PETITIONER")
    return f"""SELECT case_id, pos, g AS entity_group, upper(g[1]) || lower(g[2:]) || ' ' || CAST(case_id % 13 + pos AS VARCHAR) || CASE WHEN (case_id + pos) % 10 = 5 THEN ' ' || {_sql_choose("case_id % 6", COURTS)} ELSE '' END AS word,
        ((case_id * 3 + pos * 7) % 20) / 20.0::DOUBLE AS score FROM (SELECT *, {_sql_choose("(case_id + pos) % 10", groups)} AS g FROM (SELECT o_orderkey AS case_id, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9]) AS pos FROM orders) WHERE pos < case_id % 11)"""


#: Common table expressions of the inputs, by name.
SQL = {"case_text": _sql_case_text(), "case_profile": _sql_case_profile(), "precedents": _SQL_PRECEDENTS, "entities": _sql_entities()}


def with_inputs(sql: str, *names: str) -> str:
    """The query with the inputs it names before it."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + sql
