import json

import pytest
from pyspark.sql import functions as F

from kelpie.operators import chat, corpus, evaluate
from kelpie.plans import scan
from kelpie.sources import readers, sinks
from kelpie.streaming import guard

REGEX = {"detector_mode": "regex"}


def test_only_the_last_user_turn_changes(spark):
    rows = [(1, 0, "user", "a@b.co"), (1, 1, "user", "c@d.co"), (1, 2, "assistant", "e@f.co"), (2, 0, "assistant", "g@h.co"), (3, 0, "user", None)]
    out = chat.guard_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), config=REGEX)
    assert sorted((r.conv_id, r.turn, r.text) for r in out.collect()) == [(1, 0, "a@b.co"), (1, 1, "[EMAIL]"), (1, 2, "e@f.co"), (2, 0, "g@h.co"), (3, 0, None)]


def test_payloads_keep_other_blocks(spark):
    payload = [("user", [("text", "old a@b.co")]), ("user", [("text", "mail a@b.co"), ("tool_result", "c@d.co"), ("text", "fine")]), ("assistant", [("text", "x@y.co")])]
    df = spark.createDataFrame([(1, payload), (2, [("assistant", [("text", "x@y.co")])])], f"id long, messages {chat.BLOCKS}")
    got = {r.id: r for r in chat.guard_payloads(df, "id", config=REGEX).collect()}
    assert [[b.text for b in m.content] for m in got[1].messages] == [["old a@b.co"], ["mail [EMAIL]", "c@d.co", "fine"], ["x@y.co"]]
    assert got[1].finding_types == ["email"] and got[2].finding_types == [] and got[2].messages[0].content[0].text == "x@y.co"


def test_prompts_fail_closed(spark):
    events = ['{"prompt":"hi"}', '{"prompt":"a@b.co"}', '{"prompt":""}', '{"user_input":"hi"}', "{}", '{"prompt":null}', '{"prompt":3}', "[1]", "broken", None]
    df = spark.createDataFrame(list(enumerate(events)), "id long, value string")
    rows = chat.guard_prompts(df, config=REGEX).orderBy("id").collect()
    assert [r.decision for r in rows] == ["allow", "block", "allow", "allow", *["block"] * 6]
    assert "a@b.co" not in str(rows)
    assert {r.decision for r in chat.guard_prompts(df, enforce=False, config=REGEX).collect()} == {"allow"}


def test_metrics(spark):
    df = spark.createDataFrame([("abc def", [(0, 3), (4, 7)], [0.9, 0.2], [(0, 3)]), ("xyz", [(0, 3)], [0.6], [])], "text string, spans array<struct<start:int,end:int>>, scores array<double>, gold array<struct<start:int,end:int>>")
    pieces = evaluate.scored_pieces(df, ["text"])
    m = evaluate.piece_metrics(pieces).first()
    assert (m.tp, m.fp, m.fn, m.tn, m.precision, m.recall) == (1, 1, 0, 1, 0.5, 1.0)
    assert evaluate.piece_metrics(pieces.limit(0)).first().f1 == 0.0
    sweep = {round(r.threshold, 2): (r.tp, r.fp) for r in evaluate.threshold_sweep(pieces).collect()}
    assert sweep[0.3] == (1, 1) and sweep[0.7] == (1, 0) and len(sweep) == 9
    assert [r.text for r in evaluate.hard_examples(df).collect()] == ["xyz"]
    assert [(r.kind, r.rank) for r in evaluate.errors(pieces).collect()] == [("false_positive", 1)]
    match = evaluate.match_predictions(df.withColumn("pred", F.slice("spans", 1, 1))).first()
    assert (match.tp, match.fp, match.fn) == (1, 1, 0)


def test_values_and_recall(spark):
    df = spark.createDataFrame([("Ann met BOB", "[PII] met BOB", ["ann", "bob"], ["met", "gone"], [(0, 3)]), ("x", "x", [], [], [])], "text string, masked string, pii array<string>, keep array<string>, spans array<struct<start:int,end:int>>")
    v = evaluate.value_metrics(df).first()
    assert (v.tp, v.fn, v.tn, v.fp, v.clean_inputs, v.clean_inputs_touched) == (1, 1, 1, 1, 1, 0)
    r = evaluate.candidate_recall(df).first()
    assert (r.gold, r.covered, r.recall) == (2, 1, 0.5)
    assert evaluate.candidate_recall(df.limit(0)).first().recall == 1.0


def test_comparison(spark):
    make = lambda rows: spark.createDataFrame(rows, "id long, start int, end int, p double")
    a, b = make([(1, 0, 3, 0.9), (1, 5, 8, 0.6), (2, 0, 1, 0.5)]), make([(1, 0, 3, 0.8), (1, 5, 8, 0.4), (3, 0, 1, 0.5)])
    s = evaluate.comparison_stats(evaluate.compare_detectors(a, b, ["id", "start", "end"])).first()
    assert (s.shared, s.only_a, s.only_b, s.crossed, s.max_delta, s.median_delta, s.interchangeable) == (2, 1, 1, 1, 0.2, 0.2, False)
    assert corpus.span_difference(a, b, ["id", "start", "end"]).count() == 2


def test_conversion_checks_offsets(spark):
    span = lambda a, b, t, label: (a, b, t, label)
    rows = [("Ann in Rome", [span(0, 3, "Ann", "first_name"), span(7, 11, "Rome", "city"), span(1, 3, "Ann", "last_name")]), ("x", [span(0, 1, "x", "shoe_size")]), ("", []), (None, None)]
    out = corpus.convert(spark.createDataFrame(rows, f"text string, spans {corpus.SPAN}")).collect()
    assert len(out) == 1 and [tuple(s) for s in out[0].pii_spans] == [(0, 3, "person_name")] and out[0].keep == ["Rome"]


def test_label_map_is_disjoint(spark):
    table = corpus.label_table(spark)
    assert corpus.label_overlaps(table).count() == 0
    assert {r.bucket: r["count"] for r in table.groupBy("bucket").count().collect()} == {"adopt": 36, "negative": 9, "sensitive": 7, "skip": 3}
    row = spark.range(1).select(corpus.bucket_of(F.lit("age")).alias("b"), corpus.bucket_of(F.lit("zzz")).alias("u")).first()
    assert tuple(row.b) == ("sensitive", "sensitive_attribute") and tuple(row.u) == ("unmapped", None)


def test_latest_turns_meet_by_conversation_and_turn(spark):
    mail = "mail a@b.co"
    rows = [(1, 1, "user"), (1, 2, "user"), (1, 2, "assistant"), (1, 3, "assistant"), (1, None, "user"), (None, 5, "user"), (None, 4, "user"), (2, 1, None), (3, 7, "user"), (3, 7, "user")]
    out = chat.guard_turns(spark.createDataFrame([(*r, mail) for r in rows], "conv_id long, turn long, role string, text string"), config=REGEX)
    changed = [(r.conv_id, r.turn, r.role) for r in out.collect() if r.text != mail]
    assert out.count() == len(rows)
    assert sorted(changed, key=str) == sorted([(1, 2, "user"), (None, 5, "user"), (3, 7, "user"), (3, 7, "user")], key=str)


def test_stratified_sample_has_its_size(spark):
    rows = [(i, [["date"], ["ipv4"], ["date", "city"]][i % 3], ["x"] * (i % 2), "us") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, source_labels array<string>, keep array<string>, locale string")
    got = corpus.stratified(df, "id", 100).collect()
    assert len(got) == len({r.id for r in got}) == 100
    assert sum(r.source_labels == ["date"] for r in got) <= 20


def test_splits_and_systematic_samples(spark):
    df = corpus.parity_split(spark.range(1000), "id")
    n = {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    assert n["test"] == 500 and 60 < n["val"] < 140
    got = sorted(r.id for r in readers.systematic(spark.range(0, 2000, 2).repartition(5), "id", [0, 100, 900], 3).collect())
    assert got == [0, 2, 4, 200, 202, 204, 1800, 1802, 1804]


def test_sources(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps(["a", "b"]))
    (tmp_path / "o.json").write_text(json.dumps([{"text": "x", "pii": ["x"], "keep": []}, {"text": "y"}]))
    (tmp_path / "l.txt").write_text("one\n\n  \ntwo\n")
    assert [(r["index"], r.text) for r in readers.json_strings(spark, str(tmp_path / "t.json")).collect()] == [(0, "a"), (1, "b")]
    assert [r.pii for r in readers.json_objects(spark, str(tmp_path / "o.json")).collect()] == [["x"], None]
    assert [r.text for r in readers.lines(spark, str(tmp_path / "l.txt")).collect()] == ["one", "two"]
    raw = ["[{'start': 0, 'end': 1, 'text': 'x', 'label': 'city'}]", '[{"start":0,"end":1,"text":"x","label":"city"}]', "junk(", None]
    got = spark.createDataFrame([(x,) for x in raw], "raw string").select(readers.parse_spans(F.col("raw")).alias("s")).collect()
    assert [len(r.s) for r in got] == [1, 1, 0, 0]
    with pytest.raises(FileNotFoundError):
        readers.model_dir("m", str(tmp_path / "none"))
    assert readers.model_dir("m", str(tmp_path)) == str(tmp_path)


def test_generated_examples_are_reproducible(spark):
    a, b = (readers.generate(spark, 50, 3).repartition(n).orderBy("index").collect() for n in (1, 4))
    assert a == b and all(0 <= s.start < s.end <= len(r.text) for r in a for s in r.pii_spans)


def test_sinks_hold_no_original(spark, tmp_path):
    df = scan.redact(spark.createDataFrame([(1, "a@b.co"), (2, "plain words")], "id long, text string"), config=REGEX)
    sinks.diagnostics(df, str(tmp_path / "d"))
    sinks.audit(chat.reports(df, ["id"]), str(tmp_path / "a"))
    sinks.corpus(df.select("id"), str(tmp_path / "c"))
    logged = "".join(p.read_text() for p in (tmp_path / "d").glob("*.json"))
    assert "[EMAIL]" in logged and "a@b.co" not in logged and "plain" not in logged
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2 and spark.read.json(str(tmp_path / "c")).count() == 2


def test_stream_guard(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "a@b.co"), (2, "fine"), (3, "a" * 60 + "!")], "id long, text string").write.json(str(source))
    stream = spark.readStream.schema("id long, text string").json(str(source))
    config = REGEX | {"custom_patterns": [{"name": "slow_one", "pattern": r"(a|aa)+$"}]}
    query = guard.start_guard(stream, str(tmp_path / "ok"), str(tmp_path / "no"), str(tmp_path / "cp"), config=config, once=True)
    query.awaitTermination()
    assert {r.id: r.text for r in spark.read.parquet(str(tmp_path / "ok")).collect()} == {1: "[EMAIL]", 2: "fine"}
    assert [(r.id, r.text) for r in spark.read.parquet(str(tmp_path / "no")).collect()] == [(3, None)]


def test_session_counts(spark):
    df = spark.createDataFrame([("2026-01-01 00:00:01", "s", 1, "block"), ("2026-01-01 00:01:00", "s", 0, "allow"), ("2026-01-01 00:09:00", "s", 2, "block")], "ts string, session_id string, finding_count int, decision string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.messages, r.findings, r.blocked) for r in guard.session_counts(df).collect()) == [(1, 2, 1), (2, 1, 1)]
