"""Order-dependent clusters against plain loops over all rows, sinks, and the streaming form of delayed evaluation."""

import os
import re

import pytest
from pyspark.sql import functions as F

from eventloom import plans
from eventloom.sources.sinks import publish, write_csv, write_json
from eventloom.streaming.jobs import delayed_evaluation

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def title_words(text):
    return {w for w in re.sub("[^a-zа-яё0-9]+", " ", (text or "").split("\n")[0].lower()).split(" ") if len(w) >= 3}


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    return [(r.doc_id, r.source, title_words(r.text), {r.lang}, r.n_chars) for r in rows]


def share(a, b):
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def leaders(docs, hours):
    out, led = {}, []
    for n, source, words, _, _ in docs:
        hit = next((m for m, s, w in led if s == source and n - m <= hours and share(words, w) >= 0.6), n)
        out[n] = hit
        if hit == n:
            led.append((n, source, words))
    return out


def got(spark, name):
    return {r.doc_id: r.leader_id for r in plans.queries()[name](spark, SF).collect()}


def test_leader_clusters(spark, docs):
    assert got(spark, "dedup_eval_events") == leaders(docs, 48)
    assert got(spark, "audit_clusters") == leaders(docs, 72)
    labelled = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert got(spark, "dedup_predictions") == leaders([x for x in docs if x[0] in labelled], 48)


def test_representatives(spark, docs):
    out, groups = {}, []
    for n, source, words, _, weight in docs:
        for g in groups:
            if g["source"] == source and n - g["first"] <= 48 and share(words, g["words"]) >= 0.6:
                out[n] = g["first"]
                if weight > g["weight"]:
                    g["words"], g["weight"] = words, weight
                break
        else:
            groups.append({"source": source, "first": n, "words": words, "weight": weight})
            out[n] = n
    assert got(spark, "cluster_events") == out


def test_components_with_a_veto(spark, docs):
    groups = []
    for n, source, words, marks, _ in docs:
        mine = [(n, words, marks)]
        for g in list(groups):
            near = g["source"] == source and any(n - m <= 72 and (words == w or share(words, w) >= 0.6) for m, w, _ in g["members"])
            if near and not any(a[2] - b[2] and b[2] - a[2] for a in mine for b in g["members"]):
                mine = g["members"] + mine
                groups.remove(g)
        groups.append({"source": source, "members": mine})
    expected = {m: min(x[0] for x in g["members"]) for g in groups for m, _, _ in g["members"]}
    assert got(spark, "eval_clusters") == expected
    first = {}
    for n, lead in expected.items():
        first.setdefault(lead, []).append(n)
    assert {r.doc_id: r.n for r in plans.queries()["dedup_outcomes"](spark, SF).collect()} == {min(m): len(m) for m in first.values()}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", None), (2, "", 3.5)], "id long, name string, extra double")
    write_csv(df.coalesce(1), str(tmp_path / "c"), ["id", "name", "missing"])
    raw = b"".join(p.read_bytes() for p in (tmp_path / "c").glob("*.csv"))
    assert raw.startswith(b"\xef\xbb\xbfid,name,missing\n") and b'1,"a,b",\n' in raw
    write_json(df, str(tmp_path / "j"), ["id", "missing"])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"id":1,"missing":null}', '{"id":2,"missing":null}']
    publish(df, str(tmp_path / "p"))
    with pytest.raises(FileExistsError):
        publish(df.limit(0), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2 and len(list(tmp_path.glob("p*"))) == 1


def test_delayed_evaluation(spark, tmp_path):
    at = lambda s: F.to_timestamp(F.lit(s))
    signals = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 01:00:00"), (3, "b", "2024-01-01 00:00:00")], "id long, ticker string, s string").select("id", "ticker", F.to_timestamp("s").alias("decision_at"))
    bars = spark.createDataFrame([("a", "2024-01-01 04:05:00", 1.5), ("a", "2024-01-01 04:15:00", 1.6), ("a", "2024-01-01 05:30:00", 9.0), ("b", "2024-01-01 03:59:00", 7.0)], "ticker string, s string, price double").select("ticker", F.to_timestamp("s").alias("at"), "price")
    for n, (df, late) in enumerate(((signals, "decision_at"), (bars, "at"))):
        path = str(tmp_path / f"in{n}")
        df.coalesce(1).write.parquet(path)
        # A row of a far later time moves the watermark on.
        later = df.limit(1).withColumn(late, at("2024-01-03 00:00:00")).withColumn("ticker", F.lit("z"))
        later.coalesce(1).write.mode("append").parquet(path)
    read = lambda n, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"in{n}"))
    job = delayed_evaluation(read(0, signals.schema), read(1, bars.schema))
    run = job.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).groupBy("id").agg(F.min_by("price", "observed_at").alias("price")).collect()
    assert {r.id: r.price for r in rows if r.id in (1, 2, 3)} == {1: 1.5, 2: None, 3: None}
