"""Remote sources, service clients and the index store with stand-ins for what lies outside."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.operators.merge_table import MergeTable
from caseloom.sources import clients, remote
from caseloom.sources.index_store import IndexStore
from caseloom.streaming import stream


def _echo(url: str) -> str:
    if "down" in url:
        raise OSError("no route")
    return f'<div class="result"><a href="/doc/7/">{url.split("?")[1].replace("&", " ")}</a></div><div class="result"><a href="/doc/8/">x</a></div>'


def test_predicates_become_fields_of_the_request(spark):
    remote.register(spark, _echo, "search_a")
    found = spark.read.format("search_a").load().filter("query in ('a b', 'c') and court = 'sc' and year >= 1990 and year < 2001 and title like 'formInput=c%'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    # What the service keeps is not in Spark's filter; what it can't is.
    assert "StartsWith(title" in plan and "court" not in plan.split("Filter")[1].split("\n")[0] and "year" not in plan.split("Filter")[1].split("\n")[0]
    assert [r["title"] for r in found.collect()] == ["formInput=c order=date court=sc minYear=1990 maxYear=2000"]


def test_predicates_that_leave_nothing_to_ask(spark):
    remote.register(spark, _echo, "search_b")
    read = lambda: spark.read.format("search_b").option("queries", "a\nb")
    assert read().load().filter("query = 'zz'").count() == 0
    assert read().load().filter("year > 2000 and year < 2000").count() == 0
    assert {r["query"] for r in read().load().filter("query = 'b'").collect()} == {"b"}
    # A court beside the option's is not asked for; Spark filters the rows that come.
    assert read().option("court", "sc").load().filter("court = 'hc'").count() == 0
    assert spark.read.format("search_b").load().count() == 0


def test_failed_search_is_a_row(spark):
    remote.register(spark, _echo, "search_c")
    rows = {r["query"]: (r["status"], r["error"]) for r in spark.read.format("search_c").option("queries", "down\nup").option("limit", "1").load().collect()}
    assert rows["up"] == (200, None) and rows["down"][0] == 502 and "no route" in rows["down"][1]


def test_documents_that_cannot_be_had_are_rows(spark):
    def get(url: str) -> tuple[int, str]:
        if "/3/" in url:
            raise OSError("timed out")
        return (404, "") if "/2/" in url else (200, f"<p>{url}</p>")

    asked = spark.createDataFrame([("1", None), ("2", None), ("3", None), ("1", None), (None, None), ("9", "http://else.where/doc")], "doc_id string, url string").repartition(3)
    got = {r["doc_id"]: r for r in remote.fetch_documents(asked, get, pause=0.0).collect()}
    assert set(got) == {"1", "2", "3", "9"} and [got[i]["status"] for i in "1239"] == [200, 502, 502, 200]
    assert got["1"]["html"] == f"<p>{remote.judgment_url('1')}</p>" and "404" in got["2"]["error"] and "timed out" in got["3"]["error"] and got["3"]["html"] is None


def test_a_host_gets_one_request_in_its_pause(spark, tmp_path):
    def get(url: str) -> tuple[int, str]:
        import time

        with open(f"{tmp_path}/{url.split('/')[2]}", "a") as f:
            f.write(f"{time.monotonic()}\n")
        return 200, ""

    asked = spark.createDataFrame([(str(i), f"http://host{i % 2}/{i}") for i in range(12)], "doc_id string, url string").repartition(4)
    assert remote.fetch_documents(asked, get, pause=0.1).count() == 12
    for host in ("host0", "host1"):
        times = sorted(float(x) for x in (tmp_path / host).read_text().split())
        assert len(times) == 6 and all(b - a > 0.09 for a, b in zip(times, times[1:], strict=False))


def _service(make, answers, **options):
    """A service that gives each text its own row of answers; exceptions are raised."""

    def post(url, headers, payload, timeout):
        assert headers["Authorization"] == "Bearer k"
        given = calls.setdefault(payload["inputs"], iter(answers[payload["inputs"]]))
        answer = next(given)
        if isinstance(answer, Exception):
            raise answer
        status, headers, body = answer
        return status, headers, json.dumps(body).encode()

    calls: dict = {}
    return make("http://model", post=post, key="k", sleep=lambda s: slept.append(s), **options), (slept := [])


@pytest.mark.parametrize(
    ("answers", "status", "attempts", "slept"),
    [
        ([(200, {}, [[1, 2]])], "ok", 1, []),
        ([(200, {}, {"embeddings": [[1, 2]]})], "ok", 1, []),
        ([(503, {}, ""), (503, {"Retry-After": "7"}, ""), (200, {}, [[1, 2]])], "ok", 3, [2.0, 7.0]),
        ([(429, {}, ""), OSError("cut"), (200, {}, [[1, 2]])], "ok", 3, [2.0, 4.0]),
        ([(503, {"retry-after": "soon"}, "")] * 3, "loading", 3, [2.0, 4.0, 6.0]),
        ([(429, {}, "")] * 3, "failed", 3, [2.0, 4.0, 8.0]),
        ([OSError("cut")] * 3, "failed", 3, [2.0, 4.0, 8.0]),
        ([(500, {}, "")], "failed", 1, []),
        ([(404, {}, "")], "missing", 1, []),
        ([(200, {}, {"odd": 1})], "failed", 1, []),
        ([(200, {}, [1.0, 2.0])], "failed", 1, []),
    ],
)
def test_embedding_policy(answers, status, attempts, slept):
    service, waited = _service(clients.embedding_service, {"t": answers})
    said = service.ask("t")
    value = clients.embedding_of(said["body"]) if said["status"] == "ok" else None
    assert (said["attempts"], waited) == (attempts, slept)
    assert said["status"] == status if value is not None or said["status"] != "ok" else status == "failed"
    assert value == ([1.0, 2.0] if status == "ok" else None)


def test_recogniser_tells_at_once_that_its_model_loads():
    service, waited = _service(clients.recogniser_service, {"t": [(503, {}, "")], "u": [(503, {"retry-after": "3.5"}, "")], "v": [(429, {}, ""), (200, {}, [{"entity": "LAW", "word": " x "}, "?", [{"entity_group": "ORG", "score": 0.5}]])]})
    assert [(a["status"], a["retry_after"]) for a in map(service.ask, "tu")] == [("loading", 20.0), ("loading", 3.5)] and not waited
    said = service.ask("v")
    assert said["status"] == "ok" and waited == [2.0]
    assert [(e["pos"], e["entity_group"], e["word"], e["score"]) for e in clients.entities_of(said["body"])] == [(0, "LAW", "x", 0.0), (2, "ORG", "", 0.5)]


def _vector_of_length(url, headers, payload, timeout):
    text = payload["inputs"]
    if text == "bad":
        return 500, {}, b"no"
    return 200, {}, json.dumps([[float(len(text)), 1.0]]).encode()


def test_embedding_rows_and_their_outcomes(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, None), (3, "bad"), (4, "abc")], "id long, text string").withColumn("status", F.lit("clash"))
    got = {r["id"]: r for r in clients.embed(rows, clients.embedding_service("http://model", post=_vector_of_length)).collect()}
    assert got[1]["embedding"] == got[4]["embedding"] == [3.0, 1.0] and got[2]["embedding"] == [0.0, 1.0]
    assert got[3]["embedding"] is None and got[3]["status"] == "failed" and "500" in got[3]["error"] and got[1]["status"] == "ok"


def test_queue_of_a_model_that_loads(spark, tmp_path):
    def post(url, headers, payload, timeout):
        with open(f"{tmp_path}/{payload['inputs']}", "a+") as f:
            f.write("x")
            f.seek(0)
            n = len(f.read())
        if payload["inputs"] == "never" or (payload["inputs"] == "slow" and n < 3):
            return 503, {"retry-after": "9"}, b""
        return 200, {}, json.dumps([{"entity_group": "LAW", "word": payload["inputs"], "score": 0.9}]).encode()

    cases = spark.createDataFrame([(1, "fast"), (2, "slow"), (3, "never")], "case_id long, case_text string")
    waited: list = []
    service = clients.recogniser_service("http://model", post=post)
    found = {r["case_id"]: r for r in clients.drain(cases, lambda q: clients.recognise(q, service), rounds=4, sleep=waited.append).collect()}
    assert {k: r["status"] for k, r in found.items()} == {1: "ok", 2: "ok", 3: "loading"} and waited == [9.0] * 3
    assert [len((tmp_path / n).read_text()) for n in ("fast", "slow", "never")] == [1, 3, 4]
    assert found[2]["entities"][0]["word"] == "slow" and found[3]["entities"] is None


# --- The index store and the table that is merged when it is read


CHUNK = "doc_id long, chunk_index int, embedding array<float>"


def _store(spark, tmp_path, **other):
    return IndexStore(spark, f"file://{tmp_path}/index", **({"model": "m", "dimension": 2} | other))


def test_index_batches_count_once(spark, tmp_path):
    store = _store(spark, tmp_path)
    first, second = spark.createDataFrame([(1, 0, [0.0, 1.0]), (1, 1, [1.0, 0.0])], CHUNK), spark.createDataFrame([(2, 0, [1.0, 1.0])], CHUNK)
    assert not store.load().ok and "no index" in store.load().problems[0]
    assert [store.append(first, 0), store.append(first, 0), store.append(second, 1), store.append(first.limit(0), 2)] == [2, 0, 1, 0]
    # A part without a commit, as a crash leaves it, does not count.
    second.write.parquet(store.log.new_part("batch-9"))
    loaded = _store(spark, tmp_path).load()
    assert loaded.ok and (loaded.batches, loaded.vectors, loaded.documents) == (3, 3, 2) and loaded.index.count() == 3


def test_index_from_a_stream_that_starts_again(spark, tmp_path):
    store = _store(spark, tmp_path)
    for i in range(3):
        spark.createDataFrame([(i, 0, [1.0, float(i)])], CHUNK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []

    def sink(df, batch):
        store.append(df, f"s-{batch}")
        seen.append(batch)
        if len(seen) == 2:
            raise RuntimeError("lost after the commit")

    run = lambda: stream.run_available(stream.read_stream(spark, str(tmp_path / "in"), first.schema, files_per_trigger=1), sink, str(tmp_path / "checkpoint"))
    first = spark.read.parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="lost after the commit"):
        run()
    run()
    assert seen == [0, 1, 1, 2] and store.load().vectors == 3


def test_what_a_load_reports(spark, tmp_path):
    store = _store(spark, tmp_path)
    with pytest.raises(ValueError, match="2 of 3 vectors"):
        store.append(spark.createDataFrame([(1, 0, [0.0]), (1, 1, None), (1, 2, [1.0, 0.0])], CHUNK), 0)
    assert not store.load().ok
    empty = _store(spark, tmp_path / "empty")
    empty.append(spark.createDataFrame([], CHUNK), 0)
    assert empty.load().problems == ["no vectors"]
    rows = spark.createDataFrame([(1, 0, [0.0, 1.0])], CHUNK)
    store.append(rows, 1)
    assert "3 dimensions" not in str(store.load().problems) and store.load().ok
    assert _store(spark, tmp_path, dimension=3).load().problems == ["batch of m, 2 dimensions", "1 vectors are null or not of dimension 3"]
    assert _store(spark, tmp_path, model="other").load().problems == ["batch of m, 2 dimensions"]
    rows.write.mode("append").parquet(store.log.all()[0]["part"])
    assert store.load().problems == ["2 vectors where 1 were committed"]
    store.log.drop(store.log.all()[0]["part"])
    assert "unreadable" in store.load().problems[0]


ENTRY = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("ts", T.LongType())])


def _rows(table, keys=None):
    return {r["key"]: (r["value"], r["ts"]) for r in table.read(keys).collect()}


def test_merge_table_equals_a_dict(spark, tmp_path):
    table, want = MergeTable(spark, f"file://{tmp_path}/t", ENTRY, buckets=8), {}
    rng = random.Random(8)
    for n in range(7):
        entries = {rng.choice([None, *"abcdefghij"]): (rng.random(), n) for _ in range(4)}
        table.put(spark.createDataFrame([(k, v, t) for k, (v, t) in entries.items()], ENTRY), batch_id=f"b{n}")
        want |= entries
        if n == 3:
            table.delete(spark.createDataFrame([("a",), ("b",)], "key string"))
            want = {k: v for k, v in want.items() if k not in ("a", "b")}
        if n == 5:
            assert table.compact(most_parts=1) and not table.compact(most_parts=1)
        assert _rows(table) == want
    assert table.put(spark.createDataFrame([("z", 1.0, 1)], ENTRY), batch_id="b0") == [] and _rows(table) == want
    assert _rows(table, ["c", None, "nothing"]) == {k: v for k, v in want.items() if k in ("c", None)}
    assert table.vacuum() > 0 and _rows(table) == want
    assert MergeTable(spark, f"file://{tmp_path}/t", ENTRY, buckets=8).read().count() == len(want)
    assert _rows(MergeTable(spark, f"file://{tmp_path}/none", ENTRY)) == {}


def test_a_put_touches_its_buckets_alone(spark, tmp_path):
    table = MergeTable(spark, f"file://{tmp_path}/t", ENTRY, buckets=16)
    every = table.put(spark.range(500).selectExpr("cast(id as string) as key", "1.0d as value", "id as ts"))
    assert every == list(range(16))
    before = sorted(str(p) for p in (tmp_path / "t" / "data").rglob("*.parquet"))
    touched = table.put(spark.createDataFrame([("7", 2.0, 9)], ENTRY))
    new = [str(p) for p in (tmp_path / "t" / "data").rglob("*.parquet") if str(p) not in before]
    assert len(touched) == len(new) == 1 and f"_bucket={touched[0]}" in new[0]
    plan = table.read(["7"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [") == 2 and "_bucket#" in plan and all(f"= {touched[0]}" in p.split("]")[0] or f"IN ({touched[0]})" in p.split("]")[0] for p in plan.split("PartitionFilters: [")[1:])
    assert _rows(table, ["7"]) == {"7": (2.0, 9)} and len(_rows(table)) == 500


def test_two_keys_in_one_put_and_two_writers(spark, tmp_path):
    table = MergeTable(spark, f"file://{tmp_path}/t", ENTRY)
    table.put(spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 0), ("a", 2.0, 2)], ENTRY))
    assert _rows(table) == {"a": (3.0, 0)}
    assert table.log.commit("000000000001", {"number": 1, "name": None, "part": "x", "buckets": [], "merged": []})
    assert not table.log.commit("000000000001", {})
    assert table.put(spark.createDataFrame([("b", 1.0, 1)], ENTRY)) and set(_rows(table)) == {"a", "b"}
