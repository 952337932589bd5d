"""The mix against a plain scheduler, at exact weights, for any number of sources, and without losing a document."""

import heapq
from fractions import Fraction
from math import ceil, floor

import corpus_pipeline
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodewell.llm import mixing, queries


def flow(weights, blocks):
    """Moments at which the k-th block of each source has flowed, by running the flow from one event to the next."""
    moments, had, now = [[Fraction(0)] for _ in weights], [Fraction(0)] * len(weights), Fraction(0)
    while any(h < n for h, n in zip(had, blocks, strict=True)):
        active = [i for i, n in enumerate(blocks) if had[i] < n]
        total = sum(weights[i] for i in active)
        step = min((len(moments[i]) - had[i]) * total / weights[i] for i in active)
        now += step
        for i in active:
            had[i] += weights[i] * step / total
            if had[i] == len(moments[i]):
                moments[i].append(now)
    return moments


def plain_schedule(weights, blocks):
    """Earliest deadline first over all blocks, slot by slot."""
    moments = flow([Fraction(w) for w in weights], blocks)
    jobs = sorted((floor(moments[i][k]), ceil(moments[i][k + 1]), i, k) for i, n in enumerate(blocks) for k in range(n))
    ready, out, at = [], [], 0
    for slot in range(len(jobs)):
        while at < len(jobs) and jobs[at][0] <= slot:
            release, due, i, k = jobs[at]
            heapq.heappush(ready, (due, i, k, release))
            at += 1
        due, i, k, release = heapq.heappop(ready)
        out.append((i, k, slot, release, due))
    return out


@given(st.lists(st.tuples(st.one_of(st.integers(1, 50), st.floats(0.001, 10)), st.integers(0, 40)), min_size=1, max_size=8), st.integers(1, 30))
@settings(max_examples=80, deadline=None)
def test_stretches_equal_the_plain_scheduler(sources, stretch):
    whole = mixing.whole_weights({f"{i:03}": w for i, (w, _) in enumerate(sources)})
    course = mixing.Course(tuple(whole.values()), tuple(n for _, n in sources))
    expected = plain_schedule([w for w, _ in sources], course.blocks)
    assert list(course.schedule()) == expected
    assert all(release <= slot < due for _, _, slot, release, due in expected)
    cut = [row for at in range(0, course.slots, stretch) for row in course.schedule(at, at + stretch)]
    assert cut == expected


@given(st.lists(st.floats(0.001, 1000), min_size=1, max_size=12))
@settings(max_examples=6, deadline=None)
def test_deviation_from_the_given_weights(weights):
    """10,000 blocks, none running out: less than one block from the weights as given, exactly."""
    whole = mixing.whole_weights({f"{i:03}": w for i, w in enumerate(weights)})
    course = mixing.Course(tuple(whole.values()), (10**9,) * len(weights))
    total, done = sum(map(Fraction, weights)), [0] * len(weights)
    share = [Fraction(w) / total for w in weights]
    for i, _, slot, _, _ in course.schedule(0, 10_000):
        done[i] += 1
        if slot % 97 == 0 or slot > 9_970:
            assert all(abs(d - (slot + 1) * s) < 1 for d, s in zip(done, share, strict=True))


def test_close_weights_are_not_rounded():
    whole = mixing.whole_weights({"a": 0.33349, "b": 0.33349, "c": 0.33302})
    course = mixing.Course(tuple(whole.values()), (10**9,) * 3)
    # The deviation at a million slots, from a stretch there alone.
    counts, busy = course.flowed(1_000_000)
    assert abs(counts[0] - 333_490) <= 1 and abs(counts[2] - 333_020) <= 1
    assert len(list(course.schedule(1_000_000, 1_000_100))) == 100


def mixed(spark, rows, **settings):
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    return docs, mixing.interleave(docs, mixing.tempered_weights(docs), **settings)


def test_a_small_source_ends_no_mix(spark):
    docs, out = mixed(spark, [(i, "a") for i in range(20_000)] + [(30_000 + i, "b") for i in range(31)])
    assert out.where("mix.in_mix").count() == 20_031


def test_any_number_of_sources(spark):
    rows = [(i, f"s{i % 1500 if i % 3 else 7}") for i in range(6000)]
    docs, out = mixed(spark, rows, block_rows=2, task_slots=500)
    got = out.where("mix.in_mix").select("source", "mix.*").collect()
    assert len(got) == 6000 and len({r["position"] for r in got}) == 6000
    weights = mixing.tempered_weights(docs)
    names = sorted(weights)
    sizes = {r[0]: r[1] for r in docs.groupBy("source").count().collect()}
    expected = {(names[i], k): (slot, release, due) for i, k, slot, release, due in plain_schedule([weights[n] for n in names], [ceil(sizes[n] / 2) for n in names])}
    assert {(r["source"], r["block"]): (r["slot"], r["release"], r["deadline"]) for r in got} == expected


def test_the_query_equals_the_plain_scheduler(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op3_source_mixing"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    weights = mixing.tempered_weights(docs)
    names = sorted(weights)
    sizes = {r[0]: r[1] for r in docs.groupBy("source").count().collect()}
    expected = {(names[i], k): (slot, release, due) for i, k, slot, release, due in plain_schedule([weights[n] for n in names], [ceil(sizes[n] / 32) for n in names])}
    assert {(r["source"], r["block"]): (r["slot"], r["release"], r["deadline"]) for r in got} == expected
    assert len(got) == docs.count() == len({r["position"] for r in got}) and all(r["position"] // 32 == r["slot"] and r["in_mix"] for r in got)
    per_block = {}
    for r in got:
        per_block.setdefault((r["source"], r["block"]), []).append(r["position"])
    assert all(len(x) == 32 or k == ceil(sizes[s] / 32) - 1 for (s, k), x in per_block.items())


def test_a_rare_source_ends_no_pipeline(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(3000)] + [(5000, "rare"), (5001, None), (5002, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    out = corpus_pipeline.mix_sources(spark, docs, "")
    assert sorted((r["doc_id"], r["source"]) for r in out.collect()) == sorted(rows)


def test_one_key_for_all_rows_spreads(spark):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.col("id").alias("i"))
    out = mixing.interleave(docs, {"a": 1}, bucket_rows=100)
    assert out.columns == ["doc_id", "source", "i", "mix"] and len({r[0] for r in out.select("mix.position").collect()}) == 3000


def test_equal_rows_spread(spark):
    """A third and more of all rows are one row repeated: each has its place, and its copies do not share a hash."""
    rows = [(7, "a")] * 2000 + [(i, "b" if i % 2 else "a") for i in range(1000, 2500)] + [(None, None)] * 40
    docs, out = mixed(spark, rows, bucket_rows=100, block_rows=8)
    got = out.select("doc_id", "source", "mix.position").collect()
    assert sorted(((r[0], r[1]) for r in got), key=str) == sorted(rows, key=str)
    assert len({r["position"] for r in got}) == len(rows)
    hashed = docs.withColumn("hash", F.xxhash64("doc_id", "source"))
    spread = mixing._spread(hashed, 100)
    assert spread.count() == len(rows) and spread.where("doc_id = 7").select("hash").distinct().count() == 2000
    assert spread.where("doc_id IS NULL").select("hash").distinct().count() == 1  # few copies stay side by side
    assert spread.where("doc_id > 7").exceptAll(hashed).isEmpty()


def test_sources_of_any_type_are_mixed(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).alias("flag"), (F.col("id") % 4 * 1e9).alias("number"))
    for source in ("flag", "number"):
        out = mixing.interleave(docs, mixing.tempered_weights(docs, source=source), source=source, block_rows=4)
        assert out.where("mix.in_mix").count() == 300
