"""One row per branch of the change detection, and upkeep of the tracking table."""

import datetime
import random

from pyspark.sql import functions as F

from noteskein.functions.text import body_hash
from noteskein.operators import tracking as K
from noteskein.schemas import TRACKING


def ts(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=n)


NOTES = [
    ("new.md", "n", 1, ts(5)), ("same.md", "s", 1, ts(1)), ("body.md", "changed", 7, ts(5)), ("front.md", "---\na: 2\n---\nkept", 20, ts(5)), ("back.md", "again", 5, ts(5)),
]


def state_rows(spark):
    hashed = spark.createDataFrame([("s",), ("old",), ("kept",), ("gone",)], "t string").select("t", body_hash(F.col("t")).alias("h"))
    digest = {r["t"]: r["h"] for r in hashed.collect()}
    rows = [
        (1, "same.md", 1, ts(1), digest["s"], "active", None, False, ts(1)), (2, "body.md", 3, ts(1), digest["old"], "active", None, False, ts(1)),
        (3, "front.md", 18, ts(1), digest["kept"], "active", ts(2), True, ts(1)), (4, "gone.md", 4, ts(1), digest["gone"], "active", None, False, ts(1)),
        (5, "back.md", 4, ts(1), digest["gone"], "deleted", None, False, ts(1)),
    ]
    return spark.createDataFrame(rows, TRACKING)


def test_branches_and_repeat(spark):
    notes = spark.createDataFrame(NOTES, "id string, content string, length bigint, modified timestamp")
    listing = notes.select(F.col("id").alias("path"), "length", "modified")
    state = state_rows(spark)
    detected = K.detect_changes(listing, state, K.hash_notes(notes))
    kinds = {r["path"]: r["change_type"] for r in detected.collect()}
    assert kinds == {"new.md": "created", "same.md": "unchanged", "body.md": "modified", "front.md": "metadata_only", "gone.md": "deleted", "back.md": "created"}
    after = K.apply_changes(state, detected, F.lit(ts(6)))
    status = {r["path"]: (r["status"], r["file_size"]) for r in after.collect()}
    assert status["gone.md"] == ("deleted", 4) and status["back.md"] == ("active", 5) and status["front.md"] == ("active", 20) and len(status) == 6
    assert after.where("path = 'front.md'").first()["has_relationships"]
    again = {r["path"]: r["change_type"] for r in K.detect_changes(listing, after, K.hash_notes(notes)).collect()}
    assert set(again.values()) == {"unchanged"} and len(again) == 5
    log = {r["change_type"] for r in K.change_log(detected, F.lit(0)).collect()}
    assert log == {"created", "modified", "deleted"}


def test_only_touched_notes_are_hashed(spark):
    notes = spark.createDataFrame(NOTES, "id string, content string, length bigint, modified timestamp")
    asked = []

    def spy(paths):
        asked.extend(r["path"] for r in paths.collect())
        return K.hash_notes(notes)(paths)

    K.detect_changes(notes.select(F.col("id").alias("path"), "length", "modified"), state_rows(spark), spy)
    assert sorted(asked) == ["back.md", "body.md", "front.md", "new.md"]


def test_moves(spark):
    state = state_rows(spark)
    moves = spark.createDataFrame(
        [("same.md", "x.md", 1), ("same.md", "moved.md", 2), ("body.md", "front.md", 1), ("gone.md", "both.md", 1), ("back.md", "both.md", 1)], "old_path string, new_path string, ts bigint"
    )
    after = {r["file_id"]: (r["path"], r["status"]) for r in K.apply_moves(state, moves, F.lit(ts(9))).collect()}
    assert after == {1: ("moved.md", "active"), 2: ("body.md", "deleted"), 3: ("front.md", "active"), 4: ("gone.md", "deleted"), 5: ("both.md", "deleted")}
    triples = spark.createDataFrame([("A", "same.md"), ("B", "other.md")], "source_label string, source_file string")
    assert sorted(tuple(r) for r in K.rewrite_source_files(triples, moves).collect()) == [("A", "moved.md"), ("B", "other.md")]


def test_purge(spark):
    state = K.apply_changes(state_rows(spark), spark.createDataFrame([], "file_id bigint, path string, change_type string, length bigint, modified timestamp, old_hash string, new_hash string"), F.lit(ts(1)))
    kept = lambda now: {r["path"] for r in K.purge_deleted(state, F.lit(now)).collect()}
    assert "back.md" in kept(ts(30 * 24)) and "back.md" not in kept(ts(31 * 24)) and len(kept(ts(31 * 24))) == 4


def _plain_sessions(times, quiet):
    found = []
    for t in sorted(times):
        if found and t - found[-1][1] < quiet:
            found[-1][1], found[-1][2] = t, found[-1][2] + 1
        else:
            found.append([t, t, 1])
    return sorted(map(tuple, found))


def test_session_steps_equal_one_pass(spark):
    """Batches in any order, also events before and inside open sessions, close the sessions that all events make together."""
    rng = random.Random(3)
    quiet, minute = 60_000_000, 60_000_000
    for trial in range(3):
        times = [k * 40_000_000 for k in range(200)] if trial == 0 else []  # one session over several hours
        times += [rng.randint(0, 60 * 5) * minute + rng.randint(0, minute) for _ in range(120)]
        batches = [[t for t in times if rng.random() < 0.6 or t < 3_000_000_000] for _ in range(1)]
        batches.append([t for t in times if t not in set(batches[0])])
        opened, closed = spark.createDataFrame([], "vault_id string, lo bigint, hi bigint, n bigint, seen bigint"), []
        # The first batch keeps one session open; everything of the second that meets it, or closed ones, is told by plain code.
        frame = spark.createDataFrame([(None if trial == 2 else "v", t) for t in batches[0]], "vault_id string, ts_us bigint")
        done, opened = K.session_step(frame, opened, quiet, F.lit(100).cast("bigint"), flush=False)
        closed = sorted((r["lo"], r["hi"], r["n"]) for r in done.collect())
        kept = [(r["lo"], r["hi"], r["n"]) for r in opened.collect()]
        plain = _plain_sessions(batches[0], quiet)
        assert closed == plain[:-1] and kept == plain[-1:]
        frame = spark.createDataFrame([("v" if trial != 2 else None, t) for t in batches[1]], "vault_id string, ts_us bigint")
        done, rest = K.session_step(frame, opened, quiet, F.lit(200).cast("bigint"), flush=True)
        inside = [t for t in range(kept[0][0], kept[0][1] + 1, 30_000_000)] + [kept[0][1]]
        joined = _plain_sessions(batches[1] + inside, quiet)
        wanted = sorted((lo, hi, n - sum(lo <= t <= hi for t in inside) + kept[0][2] * (lo <= kept[0][0] <= hi)) for lo, hi, n in joined)
        assert sorted((r["lo"], r["hi"], r["n"]) for r in done.collect()) == wanted and rest.isEmpty()


def test_open_sessions_close_by_time(spark):
    opened = spark.createDataFrame([("v", 10, 20, 2, 1_000), ("w", 10, 20, 2, 50_000_000)], "vault_id string, lo bigint, hi bigint, n bigint, seen bigint")
    none = spark.createDataFrame([], "vault_id string, ts_us bigint")
    done, kept = K.session_step(none, opened, 60_000_000, F.lit(70_000_000).cast("bigint"), flush=False)
    assert [tuple(r) for r in done.collect()] == [("v", 10, 20, 2, 1_000)] and [tuple(r) for r in kept.collect()] == [("w", 10, 20, 2, 50_000_000)]
