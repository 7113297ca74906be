"""Running scores, verdicts and frames of replays against plain loops, with nulls, gaps, ties and empty tables."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ringtrace.operators import replay as Y
from ringtrace.streaming import jobs as J

PRED = "key_seed string, second long, y int, p int"


def decided(n):
    rng = random.Random(5)
    return [(rng.choice("ab"), rng.randrange(40), rng.choice([0, 0, 1, 4, 7]), rng.choice([0, 0, 1, 4, 6])) for _ in range(n)]


def scores(rows):
    """Accuracy, macro F1, MCC, share of each family and of benign rows flagged."""
    classes = sorted({c for _, _, y, p in rows for c in (y, p)})
    t, q, hit = Counter(r[2] for r in rows), Counter(r[3] for r in rows), Counter(r[2] for r in rows if r[2] == r[3])
    s, c = len(rows), sum(hit.values())
    f1 = sum(2 * hit[k] / (t[k] + q[k]) for k in classes) / len(classes)
    spread = math.sqrt(s * s - sum(v * v for v in q.values())) * math.sqrt(s * s - sum(v * v for v in t.values()))
    mcc = (c * s - sum(t[k] * q[k] for k in classes)) / spread if spread else 0.0

    def flagged(own):
        of = [r[3] != 0 for r in rows if r[2] in own]
        return sum(of) / len(of) if of else None

    return [c / s, f1, mcc, flagged({1}), flagged({7}), flagged({4}), flagged({0})]


@pytest.mark.parametrize("chunk", [3, 4096])
def test_running_metrics(spark, chunk):
    rows = decided(300)
    df = spark.createDataFrame([*rows, ("a", None, 0, 0), ("a", 3, None, 1), ("b", 3, 1, None)], PRED)
    got = Y.running_metrics(Y.second_counts(df, ["key_seed"], "second"), ["key_seed"], "second", chunk=chunk).collect()
    assert len(got) == len({r[:2] for r in rows})
    for r in got:
        own = [x for x in rows if x[0] == r.key_seed and x[1] == r.second]
        assert (r.decisions, r.alerts, r.attacks) == (len(own), sum(x[3] != 0 for x in own), sum(x[2] != 0 for x in own))
        want = scores([x for x in rows if x[0] == r.key_seed and x[1] <= r.second])
        for g, w in zip([r.accuracy, r.macro_f1, r.mcc, r.spoofing, r.flooding, r.replay, r.false_alarm], want):
            assert g == w if w is None else g == pytest.approx(w)


def test_scores_of_nothing(spark):
    none = spark.createDataFrame([], PRED)
    assert Y.running_metrics(Y.second_counts(none, [], "second"), [], "second").count() == 0
    assert Y.verdicts(none, ["key_seed", "second"]).count() == 0


def test_stream_counts_equal_batch(spark):
    df = spark.createDataFrame(decided(200), PRED)
    got = J.score_seconds(J.file_stream(spark, df, "decided"), lambda b: b, ["key_seed"], "second", "decided")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, Y.second_counts(df, ["key_seed"], "second").collect()))


def test_verdicts(spark):
    rows = [("a", 1, 4, 4), ("a", 1, 4, 1), ("a", 1, 4, 0), ("a", 2, 0, 0), ("a", 2, 0, None)]
    got = Y.verdicts(spark.createDataFrame(rows, PRED), ["key_seed", "second"])
    assert sorted(map(tuple, got.collect())) == [("a", 1, 3, 2, 1, 4), ("a", 2, 2, 0, 0, 0)]


def test_frames(spark):
    rows = [("a", 1, 9, 7, 0.0, 1.04, 2.0, 3.0, -1.0, 0), ("a", 2, 9, 7, 99.0, 5.0, 2.0, None, -1.0, 0), ("a", 3, 9, 8, 99.0, 6.0, 2.0, 3.0, -1.0, 4),
            ("a", 4, 9, 7, 950.0, 7.0, 2.0, 3.0, -1.0, 4), ("a", 5, 9, 7, None, 0.0, 0.0, 0.0, 0.0, 4)]
    tx = spark.createDataFrame(rows, "key_seed string, msgUid long, claimedStationId long, txNodeId long, txTimeMs double, trueX double, trueY double, claimedX double, claimedY double, attackId int").withColumn("part", F.lit("x"))
    got = {r.part: r for r in Y.track_frames(tx, 100.0, 4).collect()}
    gap = [Y.GAP] * 4
    assert set(got) == {0, 2} and (got[0].attack, got[0].node) == (4, 7)
    assert got[0].pos == [60, 20, 30, -10] + gap * 3 and got[2].pos == gap + [70, 20, 30, -10] + gap * 2
