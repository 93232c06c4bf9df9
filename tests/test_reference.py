"""Rules of the case operators, worked out by hand from their descriptions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.functions.numbers import rounded
from caseloom.functions.text import cut_at_space, iso_date, slug
from caseloom.operators import chunk, extract, graph, html, score, state, vector, whatif
from caseloom.plans import synth
from caseloom.sources import encoders, fixtures
from caseloom import schemas


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Section 302 IPC and section 302 ipc, u/s 420", ["Section 302 IPC", "section 302 ipc", "u/s 420"]),
        ("Sections 302 of it", []), ("302 IPC IPC", ["Section 302 IPC"]), ("under 34, 35 & 36 CrPC.", ["under 34, 35 & 36 CrPC"]), ("", []),
    ],
)
def test_sections(spark, text, want):
    assert one(spark, text, extract.sections) == want


@pytest.mark.parametrize(("blanks", "code", "found"), [(17, "IPC", True), (18, "IPC", False), (16, "CrPC", True), (17, "CrPC", False), (0, "IEA", True)])
def test_second_code_ends_within_twenty_characters(spark, blanks, code, found):
    text = spark.createDataFrame([(f"the 302 IPC{' ' * blanks}{code} applies",)], "t string")
    assert text.select(extract.sections(F.col("t"))).first()[0] == ([f"Section 302 {code}"] if found else [])


def test_inline_sections_by_intent(spark):
    assert one(spark, "302 IPC", extract.sections) == []
    assert one(spark, "302 IPC", lambda t: extract.sections(t, intent=True)) == ["Section 302 IPC"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("Under the Indian Penal Code; and the Companies Act.", ["Companies Act", "Indian Penal Code"]), ("of the Motor Vehicles Act, 1988", ["Motor Vehicles Act, 1988"]), ("Article 5 of Some Act, 1950", []), ("Some Act", [])],
)
def test_acts(spark, text, want):
    assert one(spark, text, extract.acts) == want


def test_parties(spark):
    both = "No. 5\nRam Lal ... Appellant\nversus\nState of X ... Respondent\nCORAM: A\n"
    assert one(spark, both, lambda t: extract.party(t, 1)) == "Ram Lal"
    assert one(spark, both, lambda t: extract.party(t, 2)) == "State of X"
    assert one(spark, "Petitioner: Asha versus others", lambda t: extract.party(t, 1)) == "Asha"
    assert one(spark, "nothing here", lambda t: extract.party(t, 2)) is None
    long = "\n" + "word " * 60 + "\nvs\nB\nCORAM"
    assert one(spark, long, lambda t: extract.party(t, 1)) == ("word " * 60)[:200].rsplit(" ", 1)[0] + "..."


@pytest.mark.parametrize(("text", "want"), [("the District Court then the Supreme Court", "District Court"), ("NCLAT", "Tribunal"), ("Consumer Commission", "Commission"), ("Family Court", "Family Court"), ("x", "Unknown")])
def test_court(spark, text, want):
    assert one(spark, text, extract.court_level) == want


@pytest.mark.parametrize(("text", "want"), [("first things", "criminal"), ("a writ petition on theft", "constitutional"), ("eviction", "civil"), ("GST", "tax"), ("a workman", "labour"), ("x", "other")])
def test_case_type(spark, text, want):
    assert one(spark, text, extract.case_type) == want


def test_strict_case_type(spark):
    assert one(spark, "first things", lambda t: extract.case_type(t, strict=True)) == "other"


def test_key_facts_keep_eight_in_order_with_repeats_last(spark):
    plain = [f"Plain sentence number {w} stands here." for w in "abcdefgh"]
    text = " ".join(["The accused was seen by a witness at ten.", *plain, "The accused was seen by a witness at ten."])
    got = one(spark, text, extract.key_facts)
    assert len(got) == 8
    assert got[-1] == got[-2] == "The accused was seen by a witness at ten."
    assert got[:6] == plain[:6]


def test_relief(spark):
    assert one(spark, "Prayer: set it\n aside now\n\nrest", extract.relief) == "set it aside now"
    assert one(spark, "none", extract.relief) is None


def test_containment_dedupe(spark):
    df = spark.createDataFrame([(["the order is void", "ORDER  is", "whether the order is void now", "other thing"],)], "a array<string>")
    assert df.select(extract.containment_dedupe(F.col("a"))).first()[0] == ["the order is void", "whether the order is void now", "other thing"]


def test_profiles_of_blank_and_null_texts(spark):
    rows = extract.extract_profiles(spark.createDataFrame([(1, "  \n"), (2, None), (3, "theft")], "case_id long, case_text string")).collect()
    assert [(r["confidence"], r["court_level"], r["case_type"], r["key_facts"]) for r in rows] == [(0.0, "Unknown", "other", [])] * 2 + [(0.5, "Unknown", "criminal", [])]


def test_entities_and_merge(spark):
    e = [(1, 0, "law", "Section 5", 0.9), (1, 1, "PERSON", "low", 0.2), (1, 2, "PERSON", "Asha", 0.8), (1, 3, "COURT", "District Court", 0.9), (1, 4, "COURT", "X High Court", 0.9), (1, 5, "ORG", "x", 0.9), (1, 6, "ISSUE", "is it void", 0.9), (1, 7, "RELIEF", "costs", 0.5)]
    parsed = extract.parse_entities(spark.createDataFrame(e, "case_id long, pos int, entity_group string, word string, score double"))
    row = parsed.first()
    assert (row["sections"], row["acts"], row["petitioner"], row["issues"], row["court"], row["confidence"]) == (["Section 5"], [], "Asha", ["is it void"], "X High Court", round(5.1 / 7, 4))
    profiles = extract.extract_profiles(spark.createDataFrame([(1, "Section 9 applies. theft"), (2, "theft")], "case_id long, case_text string"))
    merged = {r["case_id"]: r for r in extract.merge_entities(profiles, parsed).collect()}
    assert merged[1]["ipc_sections"] == ["Section 5", "Section 9"] and merged[1]["court_level"] == "High Court" and merged[1]["extraction_method"] == "hybrid"
    assert merged[2]["extraction_method"] == "rules" and merged[2]["confidence"] == 0.6


@pytest.mark.parametrize(("raw", "want"), [("24-04-1973", "1973-04-24"), ("31-02-1973", "31-02-1973"), ("4/5/2001 x", "2001-05-04"), ("24 April 1973", "1973-04-24"), ("24 Apr 1973", "24 Apr 1973"), ("24.04.1973", "24.04.1973"), ("", None)])
def test_dates(spark, raw, want):
    assert one(spark, raw, iso_date) == want


def test_slug_and_cut(spark):
    assert one(spark, " A b/C ", lambda t: slug("x", t)) == "x:a_b_c"
    assert one(spark, "  ", lambda t: slug("x", t)) == "x:node"
    assert one(spark, "one two three", lambda t: cut_at_space(t, 9)) == "one two..."
    assert one(spark, "onetwothree", lambda t: cut_at_space(t, 5)) == "onetw..."


def test_chunks():
    assert chunk.chunk_spans([3, 3, 3], 5, 2) == [(0, 3), (1, 6), (4, 9)]
    assert chunk.chunk_spans([2, 12, 1], 5, 2) == [(0, 2), (2, 7), (7, 12), (12, 14), (14, 15)]
    assert chunk.chunk_words("  ") == [] == chunk.chunk_words(None)
    words = " ".join(f"w{i}." for i in range(1200))
    parts = [c.split() for c in chunk.chunk_words(words)]
    assert all(len(p) <= 550 for p in parts) and parts[0] + [w for p in parts[1:] for w in p[50:]] == words.split()


def test_search_pages():
    page = '<div class="result"><a href="/doc/11/">T <b>one</b></a><span class="docCourt">High Court</span><i class="date">1-2-1990</i><p class="snippet">T one and more</p></div><div class="result">no link</div>'
    assert html.search_rows(page) == [{"title": "T one", "url": "https://indiankanoon.org/doc/11/", "doc_id": "11", "court": "High Court", "date": "1-2-1990", "snippet": "and more"}]
    assert html.search_rows('<p><a href="/doc/5/">x</a> tail</p><p>none</p>')[0]["snippet"] == "tail"
    assert html.search_rows(None) == []


def test_pages_of_any_depth(spark):
    assert html.search_rows("<p>" * 1500 + '<a href="/doc/5/">x</a>')[0]["title"] == "x"
    assert html.search_rows("<ul>" + "<li>" * 1200 + '<div class="doc"><a href="/doc/7/">y</a>') != []
    assert html.judgment("<div>" * 3000 + "a" + "</b>" * 3000)[1] == ""
    assert one(spark, "<i>" * 2000 + "deep", html.clean_text) == "deep"


def test_content_with_what_it_holds(spark):
    pages = [(1, "<div id='content'><div>a</div> b</div> c"), (2, "<div class='x MainPart'>a<div>b</div>c</div>"), (3, "<article>one<div>two</div></article>"), (4, "<h1>A &mdash; B &#8377;5 &nbsp;</h1><body>x&hellip;</body>"), (5, "<h1></h1><h2>t</h2>")]
    rows = {r["page_id"]: (r["title"], r["text"]) for r in html.parse_judgments(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    assert rows == {1: ("Judgment 1", "a b"), 2: ("Judgment 2", "a b c"), 3: ("Judgment 3", "one two"), 4: ("A — B ₹5", "x…"), 5: ("", "")}


def test_white_space_beyond_ascii(spark):
    assert one(spark, "Prayer: set\u00a0\u2003it aside\n\nrest", extract.relief) == "set it aside"
    rows = extract.extract_profiles(spark.createDataFrame([(1, "\u00a0\u2003 \n")], "case_id long, case_text string")).collect()
    assert rows[0]["confidence"] == 0.0
    assert one(spark, "One.\u00a0Two. Three", chunk.sentences) == ["One.", "Two.", "Three"]
    facts = one(spark, "The first sentence stands here.\u2003The second sentence stands here.", extract.key_facts)
    assert facts == ["The first sentence stands here.", "The second sentence stands here."]


def test_rescore_in_parts(spark):
    base = spark.createDataFrame([(1, 0.5), (2, 0.6)], "case_id long, win_probability double")
    worlds = whatif.scenario_grid(spark, 1, 1, 1)
    rows = lambda most: {tuple(r) for r in whatif.rescore(base, worlds, most=most).select("case_id", "scenario_id", "adjusted").collect()}
    assert rows(100) == rows(100_000) and len(rows(100)) == 2 * worlds.count()


def test_snippets(spark):
    row = one(spark, "word " * 200, vector.snippets)
    assert (len(row["semantic"]), len(row["keyword"]), row["card"]) == (300, 500, "word " * 39 + "word…")
    assert one(spark, "short", vector.snippets)["card"] == "short"


def test_judgment_pages(spark):
    pages = spark.createDataFrame([(1, "<h2>B</h2><div id='content'>AIR 1973 SC 14 &amp; x<script>no</script></div>"), (2, "<body>only</body>"), (3, None)], "page_id long, html string")
    rows = {r["page_id"]: r for r in html.parse_judgments(pages).collect()}
    assert rows[1]["title"] == "B" and rows[1]["text"] == "AIR 1973 SC 14 & x" and rows[1]["citations"] == ["AIR 1973 SC 14"]
    assert rows[2]["title"] == "Judgment 2" and rows[2]["text"] == "only" and rows[3]["text"] == ""


PROFILE = "case_id long, petitioner string, respondent string, legal_issues array<string>, ipc_sections array<string>, acts_referenced array<string>, court_level string, case_type string, key_facts array<string>, relief_sought string"


def test_graph_closed_form(spark, sf_dir):
    profiles, cited = synth.case_profile(spark, sf_dir), synth.precedents(spark, sf_dir)
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    sizes = profiles.join(cited.groupBy("case_id").agg(F.least(F.count("*"), F.lit(3)).alias("p")), "case_id", "left").select(
        "case_id", n("legal_issues").alias("i"), (F.col("petitioner").isNotNull().cast("int") + F.col("respondent").isNotNull().cast("int")).alias("c"), n("ipc_sections").alias("s"), n("acts_referenced").alias("a"), n("key_facts").alias("f"), F.coalesce("p", F.lit(0)).alias("p"),
    )
    tables = profiles.select("case_id").join(graph.nodes(profiles, cited).groupBy("case_id").agg(F.count("*").alias("n_nodes"), F.count_if("weak").alias("n_weak")), "case_id", "left").join(graph.edges(profiles, cited).groupBy("case_id").agg(F.count("*").alias("n_edges")), "case_id", "left")
    assert graph.graph_stats(profiles, cited).join(tables, "case_id").filter("node_count <> coalesce(n_nodes, 0) or edge_count <> coalesce(n_edges, 0) or size(weak_nodes) <> coalesce(n_weak, 0)").count() == 0
    bad = graph.graph_stats(profiles, cited).join(sizes, "case_id").filter("node_count <> i + c + s + a + f + p or edge_count <> c * i + s * i + s * c + a * c + f * c + p * i or not (size(weak_nodes) = 0 or (size(weak_nodes) = c and f = 0))")
    assert bad.count() == 0


def test_graph_of_one_case(spark):
    p = spark.createDataFrame([(1, None, "B", ["issue on 302", ""], ["Section 302 IPC"], [], "", "criminal", ["fact"], None), (2, "A", None, [], [], [], None, "civil", [], None)], PROFILE)
    e = {(r["label"], r["strength"]) for r in graph.edges(p).filter("case_id = 1").collect()}
    assert e == {("raises", 0.7), ("relates to", 0.8), ("supports", 0.6), ("supports", 0.65)}
    assert [r["weak_nodes"] for r in graph.graph_stats(p).orderBy("case_id").collect()] == [[], ["claim:a_—_civil_claim"]]
    found, between = graph.query_graph(graph.nodes(p), graph.edges(p), "302")
    assert found.count() == 2 and between.count() == 1


def test_scores(spark):
    p = spark.createDataFrame([(1, "A", "B", ["x"], ["Section 1 IPC"], [], "Supreme Court", "criminal", ["f"] * 3, "a long enough relief"), (2, None, None, None, None, None, None, None, None, None)], PROFILE)
    cited = spark.createDataFrame([(1, 0.9), (1, 0.0), (1, None)], "case_id long, similarity_score double")
    rows = {r["case_id"]: r for r in score.score_cases(p, cited).collect()}
    assert rows[1]["win_probability"] == round(0.35 * 0.55 + 0.25 * 0.55 + 0.1 + 0.08 + 0.05, 4)
    assert rows[1]["key_strengths"][0] == "Average similarity 0.55; strongest precedent at 0.90 (boosted +0.10 for high alignment)."
    assert rows[2]["win_probability"] == round(0.14 + 0.075 + 0.1 + 0.08 + 0.055, 4) and rows[2]["risk_level"] == "Unfavorable"
    assert rows[2]["key_weaknesses"] == ["No statutory references — weak legal foundation.", "Parties not identified — case framing incomplete.", "Unknown court level ('None') — conservative estimate."]


def test_what_if(spark):
    base = spark.createDataFrame([(1, 0.9), (2, 0.06)], "case_id long, win_probability double")
    worlds = spark.createDataFrame([(0, 2, "strong", 1, "district", ["a"], 2, "high"), (1, 0, "weak", 0, "supreme", [], 0, None)], "scenario_id int, additional_evidence int, evidence_quality string, additional_sections int, jurisdiction string, resolved_weak array<string>, additional_precedents int, precedent_similarity string")
    rows = {(r["case_id"], r["scenario_id"]): r for r in whatif.rescore(base, worlds).collect()}
    assert rows[1, 0]["adjusted"] == 0.95 and rows[1, 0]["delta"] == 0.34 and rows[2, 1]["adjusted"] == 0.05
    assert rows[1, 0]["changelog"] == ["✓ Added 2 evidence pieces (+6%)", "✓ Evidence quality: Strong (+5%)", "✓ Added 1 IPC section (+2%)", "✓ Moved to District Court (+8%)", "✓ Resolved 1 weak argument (+4%)", "✓ Added 2 precedents (High similarity, +9%)"]
    assert rows[1, 1]["changelog"] == ["✗ Evidence quality: Weak (-5%)", "✗ Moved to Supreme Court (-8%)"]


def test_nearest_in_any_partitioning(spark):
    v = np.random.default_rng(1).normal(size=(120, 8)).astype(np.float32)
    index = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    asked = index.filter("vec_id < 9").withColumnRenamed("vec_id", "query_id")
    d = ((v[:9, None, :].astype(float) - v[None].astype(float)) ** 2).sum(-1)
    want = {(q, int(i)) for q in range(9) for i in np.argsort(d[q], kind="stable")[:5]}
    for n in (1, 7):
        got = vector.nearest(asked, index.repartition(n), 5, block=16).collect()
        assert {(r["query_id"], r["vec_id"]) for r in got} == want and all(0.0 < r["similarity"] <= 1 for r in got)
    assert vector.nearest(asked, index, 5, max_broadcast_mb=0 or 1).count() == 45


def _copies(n: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Ids against the order of rows; many exact copies and copies that differ by less than single precision resolves in a product."""
    rng = np.random.default_rng(3)
    v = np.tile(rng.normal(size=(3, 16)), (n // 3, 1)).astype(np.float32)
    v[: n // 2, 0] = np.nextafter(v[: n // 2, 0], np.float32(9))
    v[n // 4 : n // 3, 5] = np.nextafter(v[n // 4 : n // 3, 5], np.float32(-9))
    return np.arange(n)[::-1].copy(), v


def _brute(ids: np.ndarray, v: np.ndarray, k: int) -> set:
    out = set()
    for i in range(len(v)):
        total = np.zeros(len(v))
        for c in range(v.shape[1]):
            total += (v[i, c].astype(np.float64) - v[:, c]) ** 2
        out |= {(int(ids[i]), n + 1, int(ids[j])) for n, j in enumerate(np.lexsort((ids, total))[:k])}
    return out


@pytest.mark.parametrize("sent_mb", [64, 0])
def test_nearest_with_more_copies_than_places(spark, sent_mb):
    """Also with queries that are too many to be sent round."""
    ids, v = _copies()
    index = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<float>").repartition(2)
    got = vector.nearest(index.withColumnRenamed("vec_id", "query_id"), index, 4, block=32 if sent_mb == 0 else 256, max_broadcast_mb=sent_mb)
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()} == _brute(ids, v, 4)


def test_ingest_counts_chunks_of_all_documents(spark, sf_dir, tmp_path):
    from caseloom.plans import pipelines, queries

    docs = synth.table(spark, sf_dir, "documents").select("doc_id", "text")
    want = {(r["doc_id"], r["count"]) for r in chunk.chunks(docs).groupBy("doc_id").count().collect()}
    assert any(i % 2 == 0 for i, _ in want)
    assert {tuple(r) for r in queries.pip_04_ingest_new(spark, sf_dir).select("doc_id", "chunks").collect()} == want
    fixtures.write_index(pipelines.ingest(docs.filter("doc_id % 3 = 0")), str(tmp_path / "index"))
    index = fixtures.read_index(spark, str(tmp_path / "index"))
    assert {tuple(r) for r in pipelines.ingest_counts(docs, index).select("doc_id", "chunks").collect()} == want


def test_supplement_cuts_before_it_drops(spark):
    hits = spark.createDataFrame([(1, 10, 0.9)], "query_id long, doc_id long, similarity double")
    kw = spark.createDataFrame([(1, 0, 10), (1, 1, 11), (1, 2, 12)], "query_id long, ordinal int, doc_id long")
    assert {(r["doc_id"], r["source"]) for r in vector.supplement(hits, kw, 3).collect()} == {(10, "vector"), (11, "keyword")}


def test_keyword_search_falls_back_to_all(spark):
    rows = spark.createDataFrame([(0, "Alpha", None), (1, "b", "has alpha"), (2, "c", "d")], "ordinal int, title string, snippet string")
    asked = spark.createDataFrame([(0, "ALPHA"), (1, "zzz")], "query_id int, query string")
    got = {(r["query_id"], r["ordinal"]) for r in fixtures.keyword_search(rows, asked, limit=2).collect()}
    assert got == {(0, 0), (0, 1), (1, 0), (1, 1)}
    many = spark.createDataFrame([(i, f"q{i}") for i in range(7)] + [(7, "alpha"), (8, "")], "query_id int, query string")
    got = {(r["query_id"], r["rank"], r["ordinal"]) for r in fixtures.keyword_search(rows, many, limit=2, first_rows=1).collect()}
    assert got == {(i, n + 1, n) for i in range(9) for n in (0, 1)}
    assert fixtures.keyword_search(rows, many.limit(0)).count() == 0


def test_index_and_json(spark, tmp_path):
    chunks = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0])], "doc_id long, embedding array<float>")
    fixtures.write_index(chunks, str(tmp_path / "index"))
    assert fixtures.read_index(spark, str(tmp_path / "index"), 2).count() == 1
    path = tmp_path / "f.json"
    path.write_text('{"search_results": [{"title": "t", "doc_id": "1"}], "judgment_details": {"1": {"doc_id": "1", "title": "x"}}}')
    rows, details = fixtures.read_fixture(spark, str(path))
    assert rows.count() == 1 and fixtures.lookup(details, spark.createDataFrame([("1",), ("9",)], "doc_id string")).filter("found").count() == 1
    assert spark.range(1).select(fixtures.allowed_origins(F.lit("*"), F.lit("production"))).first()[0] == []


def test_retries():
    answers = iter([(503, "loading", 1.0), (429, "slow", 0.0), (200, "ok", 0.0)])
    assert encoders.with_retries(lambda: next(answers), sleep=lambda _: None) == "ok"
    with pytest.raises(encoders.ServiceError):
        encoders.with_retries(lambda: (404, "", 0.0), sleep=lambda _: None)
    with pytest.raises(encoders.ModelLoading):
        encoders.with_retries(lambda: (503, "", 0.0), wait_while_loading=False, sleep=lambda _: None)


def test_state(spark):
    log = spark.createDataFrame([("a", 1, "pending"), ("a", 5, "done"), ("b", 2, "pending")], "task_id string, ts int, status string").withColumn("ts", F.timestamp_seconds("ts"))
    assert {(r["task_id"], r["status"]) for r in state.latest(log, "task_id").collect()} == {("a", "done"), ("b", "pending")}
    now = F.timestamp_seconds(F.lit(302))
    assert state.expired(log, now).count() == 1 and state.live(log, now, 300).count() == 2
    assert sorted(r["waited"] for r in state.running_states(log).collect() if r["waited"] is not None) == [4.0]


def test_rounding_is_that_of_the_exact_value(spark):
    rng = np.random.default_rng(9)
    values = [(0.5167 + 0.7) / 2, 0.00005, 0.00015, 0.12345, 2.5, -0.00015, 0.0, 1.0, *(float(k) / 100_000 for k in rng.integers(0, 100_000, 3000)), *(float(x) for x in rng.random(500))]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(rounded(F.col("x"), 4)).collect()] == [round(v, 4) for v in values]


def test_ranges(spark):
    bad = schemas.violations(spark.createDataFrame([(51, 0.5), (5, 1.5), (5, 0.5), (None, None)], "top_k int, confidence double")).collect()
    assert [r["violations"] for r in bad] == [["top_k"], ["confidence"]]


def test_remote_search_pushes_its_filters(spark):
    from caseloom.sources import remote

    def answer(url: str) -> str:
        return f'<div class="result"><a href="/doc/7/">{url.split("?")[1].replace("&", " ")}</a></div><div class="result"><a href="/doc/8/">x</a></div>'

    remote.register(spark, answer)
    rows = spark.read.format("judgment_search").option("queries", "a b\nc").option("court", "sc").option("year_from", "1990").option("limit", "1").load().collect()
    assert {r["query"]: r["title"] for r in rows} == {"a b": "formInput=a+b order=date court=sc minYear=1990", "c": "formInput=c order=date court=sc minYear=1990"}
    assert remote.judgment_url("5") == "https://indiankanoon.org/doc/5/"


def test_latest_status_of_a_stream(spark, tmp_path):
    from caseloom.streaming import stream

    log = spark.createDataFrame([("a", 1, "pending"), ("a", 9, "completed"), ("b", 3, "failed")], "task_id string, s int, status string").select("task_id", "status", F.timestamp_seconds("s").alias("ts"))
    log.write.parquet(str(tmp_path / "log"))
    out: list = []
    found = stream.latest_status(stream.read_stream(spark, str(tmp_path / "log"), log.schema))
    stream.run_available(found, lambda df, _: out.extend(df.collect()), str(tmp_path / "checkpoint"), mode="update")
    assert {(r["task_id"], r["status"]) for r in out} == {("a", "completed"), ("b", "failed")}


def test_elements_in_one_pass_equal_the_view_of_the_tables(spark, sf_dir):
    from caseloom.plans import synth

    profiles, cited = synth.case_profile(spark, sf_dir), synth.precedents(spark, sf_dir)
    n, e = graph.nodes(profiles, cited), graph.built_edges(profiles, cited)
    weak = graph.weak_claims(n, e)
    seen, numbered = graph.element_view(n, e, weak)
    want = [("node", r["case_id"], r["id"], r["id"], r["weak"]) for r in seen.collect()] + [("edge", r["case_id"], r["element_id"], r["id"], None) for r in numbered.collect()]
    one = graph.elements(profiles, cited)
    assert sorted(map(str, want)) == sorted(str((r["kind"], r["case_id"], r["element_id"], r["id"], r["weak"])) for r in one.collect())
    assert one._jdf.queryExecution().optimizedPlan().toString().count("Generate") <= 2
    listed = graph.graph_stats(profiles).selectExpr("case_id", "explode(weak_nodes) as id")
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, weak.select("case_id", "id").collect()))


def test_profiles_are_extracted_once_for_nodes_and_edges(spark, monkeypatch):
    from caseloom.plans import pipelines

    stored = []
    kept = pipelines.stored
    monkeypatch.setattr(pipelines, "stored", lambda df, name: stored.append(name) or kept(df, name))
    pipelines.extract_to_graph(spark.createDataFrame([(1, "Whether the order is valid in law?")], "case_id long, case_text string"))
    assert stored == ["profiles"]


def test_edges_are_built_for_the_cases_found_alone(spark, sf_dir):
    from caseloom.plans import synth

    profiles, cited = synth.case_profile(spark, sf_dir), synth.precedents(spark, sf_dir)
    asked = []
    of = lambda cases: asked.append(cases.count()) or graph.edges(profiles.join(cases, "case_id", "left_semi"), cited)
    rows = lambda pair: [sorted(map(str, df.collect())) for df in pair]
    n = graph.nodes(profiles, cited)
    assert rows(graph.query_graph(n, of, "order 77")) == rows(graph.query_graph(n, graph.edges(profiles, cited), "order 77"))
    assert asked and asked[0] <= 20


def test_encoders_chunks_and_pages_are_worked_on_a_few_at_a_time(spark):
    from caseloom.operators import html, vector

    rows = spark.range(1500, numPartitions=1)
    most = lambda texts: np.full((len(texts), 1), float(len(texts)), np.float32) if len(texts) <= 256 else 1 / 0
    assert vector.encode(rows.selectExpr("id", "'a' as text"), most).count() == 1500
    chunks = chunk.chunks(rows.selectExpr("id", "repeat(concat(id, ' '), 600) as text"), text="text")
    assert chunks.filter("text like concat(id, ' %')").count() == chunks.count() == 3000
    pages = html.parse_judgments(rows.selectExpr("id as page_id", "concat('<h1>', id, '</h1><body>x</body>') as html"))
    assert pages.filter("title = page_id").count() == 1500


def test_profile_searches_only_texts_that_can_match(spark):
    """A search of a whole text runs where a word of its pattern stands, and once; texts beyond ASCII are always searched, since case folds further there."""
    from caseloom import rules

    cases = spark.createDataFrame([(1, "x ſection 5 IPC and the Carriage Act, 1950. Writ petition.  "), (2, "Section 5 IPC and the Carriage ACT, 1950. K writ petition"), (3, "nothing")], "case_id long, case_text string")
    got = {r["case_id"]: r for r in extract.extract_profiles(cases).collect()}
    assert got[1]["ipc_sections"] == ["ſection 5 IPC"] and got[2]["ipc_sections"] == ["Section 5 IPC"] and got[3]["ipc_sections"] == []
    assert [got[i]["case_type"] for i in (1, 2, 3)] == ["constitutional", "constitutional", "other"]
    plan = extract.extract_profiles(cases)._jdf.queryExecution().optimizedPlan().toString()
    # By flags of ASCII and of other texts, each side of the parties once.
    assert plan.count(f"regexp_extract(_text") <= 2 * 6
    plain = "theft of goods. " * 3
    for pattern, words in rules.NEEDS.items():
        assert not any(w in "zzz 123" for w in words) and all(w == w.lower() for w in words), pattern
    assert [r[0] for r in spark.createDataFrame([(plain,)], "t string").select(extract.case_type(F.col("t"))).collect()] == ["criminal"]


def test_texts_of_profiles_do_not_move_for_precedents(spark, sf_dir):
    """Nodes and edges of a case need no exchange; what meets the precedents are keys and ids of issues."""
    profiles = spark.createDataFrame([(1, "P", "R", ["Whether clause 1 holds"], ["Section 5 IPC"], ["Act 1"], "High Court", "civil", ["Fact 1"], "Costs")], "case_id long, petitioner string, respondent string, legal_issues array<string>, ipc_sections array<string>, acts_referenced array<string>, court_level string, case_type string, key_facts array<string>, relief_sought string")
    cited = spark.createDataFrame([(1, r, str(r), "T", "C", "D", 0.5) for r in (1, 2, 3, 4)], "case_id long, rank int, doc_id string, title string, court string, date string, similarity_score double")
    for table, rows in ((graph.nodes(profiles, cited), 9), (graph.built_edges(profiles, cited), 12)):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        below = [part for part in plan.split("Join")[1:]]
        assert below and not any("key_facts" in line and "transform" in line for part in below for line in part.splitlines() if "Generate" in line or "_facts" in line)
        assert table.count() == rows
    assert sorted(r["ordinal"] for r in graph.built_edges(profiles, cited).collect()) == list(range(12))
    # A blank line inside a name stays; underscores at the end alone go.
    assert spark.createDataFrame([("a_\n b/ _",)], "t string").select(slug("x", F.col("t"))).first()[0] == "x:a_\n_b"
