import pytest

from logloom.functions import redaction
from logloom.plans import queries


@pytest.mark.parametrize("name", ["redacted_forms", "commit_marks"])
def test_costly_rows_of_a_small_file_are_many_tasks(spark, name):
    made = queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1


def test_texts_without_a_literal_are_looked_at_once(monkeypatch):
    asked = []
    monkeypatch.setattr(redaction, "_holds", lambda text, literals: asked.append(literals) or any(x in text for x in literals))
    extra, _ = redaction.compile_extra(["c[0-9]+"])
    assert redaction.apply_rules("said c12") == "said c12" and redaction.apply_rules("said c12", (*redaction.RULES, *extra)) == f"said {redaction.marker('custom')}" and not asked
    assert "hunter" not in redaction.apply_rules("PASSWORD=hunter2abcd12") and len(asked) < 2 * len(redaction.RULES)


def test_taints_walk_a_session_as_rounds_do(spark, monkeypatch):
    import random

    from logloom.operators import redact

    rng, rows = random.Random(3), []
    for s in range(12):
        for n in range(rng.randrange(1, 40)):
            kind = rng.choice(["taints", "starts", "follows", "follows", "answers"]) if s % 4 else rng.choice(["starts", "taints"])
            rows.append((f"s{s}", (n // 2, rng.randrange(2)), kind, f"i{rng.randrange(9)}", f"i{rng.randrange(9)}" if kind in ("starts", "follows") else None))
    rows += [("chain", (0, 0), "taints", "c0", None)] + [("chain", (k + 1, 0), "follows", f"c{k}", f"c{k + 1}") for k in range(30)]
    events = spark.createDataFrame(rows, "session_id string, at struct<line_no:int,block:int>, kind string, id string, other string")
    shown = lambda df: sorted((r.session_id, r.id, tuple(r.since)) for r in df.collect())
    rounds = shown(redact.tainted_ids(events, most=0))
    asked = []
    kept = redact.keep
    monkeypatch.setattr(redact, "keep", lambda *a, **k: asked.append(a[1]) or kept(*a, **k))
    assert shown(redact.tainted_ids(events)) == rounds == shown(redact.tainted_ids(events, most=12)) and ("chain", "c30", (30, 0)) in rounds
    asked.clear()
    redact.tainted_ids(events)
    assert len(asked) < 6
