"""Span algebra and timelines against sequential references on random spans."""

import random

import pytest
from pyspark.sql import functions as F

from tonespan.operators import library, spans, timeline

KEYS = ["rec"]


def cases(seed, n=30, grid=False):
    rng = random.Random(seed)
    rows = []
    for rec in range(n):
        for _ in range(rng.randrange(0, 12)):
            a = rng.uniform(0, 60)
            b = a + rng.choice([0.0, rng.uniform(0, 5)])
            rows.append((rec, *(round(x, 2) if grid or rec % 3 == 0 else x for x in (a, b))))
    return rows


def by_rec(rows):
    out = {}
    for rec, *rest in rows:
        out.setdefault(rec, []).append(tuple(rest))
    return {k: sorted(v) for k, v in out.items()}


def collected(df, *columns):
    return by_rec([tuple(r) for r in df.select("rec", *columns).collect()])


def merged(rows, gap=0.0, pad=0.0, limit=None):
    out = []
    for a, b in sorted(rows):
        a, b = max(0.0, a - pad), b + pad
        b = b if limit is None else min(limit, b)
        if out and a <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def frame(spark, rows):
    return spark.createDataFrame(rows, "rec int, start double, end double")


@pytest.mark.parametrize("gap", [0.0, 0.3, 1.0])
def test_gap_join(spark, gap):
    rows = cases(1)
    assert collected(spans.gap_join(frame(spark, rows), KEYS, gap), "start", "end") == {k: sorted(merged(v, gap)) for k, v in by_rec(rows).items()}


@pytest.mark.parametrize("pad,limit", [(0.0, None), (0.05, 40.0), (0.3, 20.0)])
def test_union(spark, pad, limit):
    rows = cases(2)
    got = spans.union(frame(spark, rows), KEYS, pad, None if limit is None else F.lit(limit))
    assert collected(got, "start", "end") == {k: sorted(merged(v, 0.0, pad, limit)) for k, v in by_rec(rows).items()}


def test_intersect_matches_all_pairs_of_disjoint_lists(spark):
    a, b = cases(3), cases(4)
    flat = lambda rows: [(k, *x) for k, v in by_rec(rows).items() for x in merged(v)]
    a, b = flat(a), flat(b)
    got = collected(spans.intersect(frame(spark, a), frame(spark, b), KEYS, 2.5), "start", "end")
    want = {}
    for rec, s, e in a:
        for rec2, s2, e2 in b:
            if rec == rec2 and min(e, e2) > max(s, s2):
                want.setdefault(rec, []).append((max(s, s2), min(e, e2)))
    assert got == {k: sorted(v) for k, v in want.items()}


def test_complement_and_kept_add_up(spark):
    rows = [(k, *x) for k, v in by_rec(cases(5)).items() for x in merged(v)]
    durations = spark.createDataFrame([(k, 70.0) for k in range(31)], "rec int, duration double")
    gaps = collected(spans.complement(frame(spark, rows), durations, KEYS), "start", "end")
    kept = by_rec(rows)
    for k in range(31):
        total = sum(b - a for a, b in kept.get(k, [])) + sum(b - a for a, b in gaps.get(k, []))
        assert total == pytest.approx(70.0)
    assert gaps[30] == [(0.0, 70.0)]


def test_runs(spark):
    marks = "0110111100101"
    df = spark.createDataFrame([(0, i, int(c)) for i, c in enumerate(marks)], "rec int, i long, on int")
    got = spans.runs(df, KEYS, "i", F.col("on") == 1, 2)
    assert sorted((r.first, r.stop) for r in got.select("first", "stop").collect()) == [(1, 3), (4, 8)]


def test_inside_is_half_open(spark):
    points = spark.createDataFrame([(0, t) for t in (0.0, 1.0, 1.5, 2.0, 9.0)], "rec int, t double")
    got = spans.inside(points, frame(spark, [(0, 1.0, 2.0)]), KEYS, "t", 1.0)
    assert sorted(r.t for r in got.collect()) == [1.0, 1.5]


def test_talk_rank_breaks_ties_by_first_appearance(spark):
    rows = [(0, "b", 0.0, 1.0), (0, "a", 5.0, 6.0), (0, "c", 10.0, 13.0)]
    df = spark.createDataFrame(rows, "rec int, speaker string, start double, end double")
    assert {r.speaker: r["rank"] for r in spans.talk_rank(df, KEYS).collect()} == {"c": 0, "b": 1, "a": 2}


def test_merge_adjacent_only_with_the_piece_before(spark):
    rows = [(0, 0.0, 1.0, "x"), (0, 1.01, 2.0, "x"), (0, 2.01, 3.0, "y"), (0, 3.01, 4.0, "x")]
    df = spark.createDataFrame(rows, "rec int, start double, end double, speaker string")
    got = spans.merge_adjacent(df, KEYS, "speaker", ["start"])
    assert sorted((r.start, r.end, r.speaker) for r in got.collect()) == [(0.0, 2.0, "x"), (2.01, 3.0, "y"), (3.01, 4.0, "x")]


def test_grid_covers_touched_frames(spark):
    df = spans.grid(frame(spark, [(0, 0.05, 0.21), (0, 0.2, 0.25)]), KEYS, 0.1)
    assert sorted(r.frame for r in df.collect()) == [0, 1, 2]


def test_points_there_and_back(spark):
    segments = frame(spark, [(0, 1.0, 3.0), (0, 5.0, 6.0)])
    points = spark.createDataFrame([(0, t) for t in (0.5, 1.0, 2.9, 3.0, 5.5, 6.0)], "rec int, t double")
    there = {r.t: r.joined_t for r in timeline.points_from_source(points, segments, KEYS).collect()}
    assert there == {0.5: None, 1.0: 0.0, 2.9: pytest.approx(1.9), 3.0: None, 5.5: 2.5, 6.0: None}
    joined = spark.createDataFrame([(0, t) for t in (-1.0, 0.0, 1.9, 2.0, 2.5, 3.0)], "rec int, t double")
    back = {r.t: r.source_t for r in timeline.points_to_source(joined, segments, KEYS).collect()}
    assert back == {-1.0: None, 0.0: 1.0, 1.9: pytest.approx(2.9), 2.0: 5.0, 2.5: 5.5, 3.0: None}


def test_spans_split_at_cuts(spark):
    segments = frame(spark, [(0, 1.0, 3.0), (0, 5.0, 6.0)])
    asked = frame(spark, [(0, 1.5, 2.5)])
    got = timeline.to_source(asked, segments, KEYS, 1.0)
    assert sorted((r.source_start, r.source_end) for r in got.collect()) == [(2.5, 3.0), (5.0, 5.5)]
    back = timeline.from_source(frame(spark, [(0, 2.5, 5.5)]), segments, KEYS, 1.0)
    assert sorted((r.start, r.end) for r in back.collect()) == [(1.5, 2.0), (2.0, 2.5)]


def test_cut_samples(spark):
    samples = spark.createDataFrame([(0, i, float(i)) for i in range(40)], "rec int, i long, value double")
    got = timeline.cut_samples(samples, frame(spark, [(0, 0.5, 1.0), (0, 2.0, 2.5)]), KEYS, 10)
    assert [r.value for r in got.orderBy("j").collect()] == [*range(5, 10), *range(20, 25)]


def test_empty_inputs(spark):
    none = frame(spark, [])
    assert spans.gap_join(none, KEYS).count() == spans.union(none, KEYS).count() == spans.intersect(none, none, KEYS, 1.0).count() == 0


def test_speech_segments_equal_their_sql_past_the_limit_and_without_length(spark):
    """The SQL asks of two spans only that each begins before the other ends."""
    kept = [(0, 10.0, 95.0), (0, 200.0, 200.0), (1, 10.0, 10.0), (1, 100.0, 130.0), (2, 70.0, 100.0), (3, 0.0, 300.0)]
    turns = [(0, 20.0, 21.0), (0, 90.0, 92.0), (1, 5.0, 15.0), (1, 100.5, 120.0), (1, 126.0, 128.0), (2, 96.0, 97.0), (3, 99.0, 101.0), (3, 250.0, 260.0)]

    def want(rec):
        union = merged(by_rec(turns)[rec], pad=1.0, limit=80.0)
        return sorted((max(a, c), min(b, d)) for a, b in by_rec(kept)[rec] for c, d in union if a < d and c < b)

    for width in (7.0, 50.0):
        got = library.speech_segments(frame(spark, kept), frame(spark, turns), KEYS, 1.0, F.lit(80.0), width)
        assert collected(got, "start", "end") == {rec: w for rec in range(4) if (w := want(rec))}
    assert want(3) == [(98.0, 80.0), (249.0, 80.0)] and want(1) == [(10.0, 10.0)]
