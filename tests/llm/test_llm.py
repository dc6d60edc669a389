"""Small tests of the training-text operators against brute force, with the edge cases that each docstring defines."""

import base64
import hashlib
import random
import re
import unicodedata

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from kelpie.llm import bpe, chunk_prints, common, components, entries, langid, mixing, pii_votes, quality, secret_scan, simhash, spans, substring_dedup, suffix_dedup

SF = "/root/testdata/sf0.001"
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, key string, batch int, h long, fp string, n_words int"


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, src, None, "x", 1, 2, "y", 3) for i, t, lang, src in rows], EXTRA).repartition(3)


EDGES = [(None, "no id here, one two three."), (7, None, "en", "a"), (8, "", None, None), (9, "one", "en", None), (10, "é 😀 \x00 ok\n\n\nok", "fr", "a"), (10, "é 😀 \x00 ok\n\n\nok", "fr", "a")]
EDGES = [(i, t, *(rest or ("en", "b"))) for i, t, *rest in EDGES]


@pytest.fixture(scope="module")
def rows():
    found = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT 120").fetchall()
    r, base = random.Random(1), found[1][1]
    near = []
    for k in range(12):
        words = base.split(" ")
        words[r.randrange(len(words))] = f"edit{k}"
        near.append((1000 + k, " ".join(words), "en", "src1"))
    return found + near + [(2000, "ab " * 3000, "en", "src2"), (2001, "aaaa" * 500, "en", "src2"), *EDGES]


def test_shared_folder_is_the_named_one(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.mark.parametrize("name", sorted(entries.SQL))
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df, want = entries.QUERIES[name](spark, SF), db.sql(entries.SQL[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    plain = lambda v: format(v, ".9g") if isinstance(v, float) else str(v)
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(entries.SQL))
def test_edge_cases_equal_the_sql(spark, rows, name, tmp_path):
    """Nulls, empty and long texts, repeated ids and rows."""
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE TABLE documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df, want = entries.QUERIES[name](spark, str(tmp_path)), db.sql(entries.SQL[name])
    names = sorted(df.columns)
    at = [want.columns.index(c) for c in names]
    plain = lambda v: format(v, ".9g") if isinstance(v, float) else str(v)
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(entries.QUERIES))
def test_empty_tables(spark, name, tmp_path):
    frame(spark, EDGES).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert entries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_runs_span_batches(spark, rows):
    df = frame(spark, rows)
    out = lambda **o: sorted(map(str, substring_dedup.span_dedup(df, **o).collect()))
    assert out(batch_bytes=10_000) == out(batch_bytes=10**9)


def test_passages_without_marks_are_found(spark):
    """Repeats of over 50 words in texts without sentence marks, in very short sentences, in a script without spaces, of one word."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijk") for _ in range(r.randint(2, 9)))
    text = lambda n, gap=" ": gap.join(word() for _ in range(n))
    plain, shouted, wide, same = text(60), text(60, "!! "), "".join(chr(0x4E00 + r.randrange(3000)) + "\u3002" * (k % 9 == 8) for k in range(200)), "of " * 60
    rows = [(10 * k + j, f"{text(40)} {p} {text(40)}", "en", "a") for k, p in enumerate((plain, shouted, wide, same)) for j in range(3)]
    rows += [(100 + k, text(150), "en", "a") for k in range(20)] + [(200 + k, "two words only, but a whole text of more than a hundred and twenty bytes, and it holds no more than one sentence of words in all", "en", "a") for k in range(2)]
    got = {x.doc_id: x for x in substring_dedup.span_dedup(frame(spark, rows)).collect()}
    for k in range(4):
        assert got[10 * k].n_removed == (k == 3 and got[30].n_removed)  # the first stays, but for its own repeats
        assert all(got[10 * k + j].n_removed for j in (1, 2))
    assert not any(got[100 + k].n_removed for k in range(20)) and got[200].n_removed == 0 and got[201].clean_text == ""


def test_long_texts_are_cut_in_linear_time():
    import time

    began = time.perf_counter()
    for t in ("." * 200_000 + "x", "a.b" * 100_000, ". " * 100_000, "x" * 300_000, "\n" * 300_000, "\u3002" * 100_000):
        substring_dedup.Runs(pa.array([t]))
    assert time.perf_counter() - began < 6


def test_null_ids_are_spread(spark):
    text = lambda k: " ".join(f"w{k}x{j}." for j in range(60))
    rows = [(None, text(k % 50), "en", "a") for k in range(100)] + [(1, text(3), "en", "a")]
    got = substring_dedup.span_dedup(frame(spark, rows), batch_bytes=4000).collect()
    assert sum(x.n_removed > 0 for x in got) == 2  # the null ids are one place; id 1 comes before it


def bytes_removed(docs, length):
    first = {}
    for k, b in docs:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, k), k)
    out = []
    for k, b in docs:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < k:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "gram", "alphabet"), [(50, 24, "ab"), (12, 8, "abc"), (50, 24, "a"), (20, 9, "aé"), (128, 16, "ab")])
def test_bytes_removed_equal_brute_force(spark, length, gram, alphabet):
    r = random.Random(length)
    pool = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 90))) for _ in range(12)]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 6))) for _ in range(60)] + ["", None]
    rows = [(i if i % 9 else None, t, "en", "a") for i, t in enumerate(texts)] + [(5, texts[5], "en", "a"), (5, "other " + (texts[6] or ""), "en", "a")]
    want = sorted(bytes_removed([(common.NO_ID if i is None else i, (t or "").encode()) for i, t, *_ in rows], length))
    for size in (500, 10**9):
        got = suffix_dedup.remove_repeats(frame(spark, rows), length, gram, size, size, with_bytes=True).collect()
        assert sorted((x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == want
        assert all(hashlib.sha256(x.kept).hexdigest() == x.kept_sha256 for x in got)


def test_rows_of_a_batch_come_in_any_order(spark, rows):
    """Executors hand a batch's rows to each step in another order; here they are shuffled whenever they are read."""

    def shuffled(batches):
        for b in batches:
            yield b.take(pa.array(np.random.default_rng().permutation(b.num_rows)))

    rows = rows + [(i, t + rows[k][1], "en", "a") for k in range(3) for i in (5, None) for t in (rows[4][1], "other ")]
    want = bytes_removed([(common.NO_ID if i is None else i, (t or "").encode()) for i, t, *_ in rows], 50)
    docs = frame(spark, rows)
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        for size in (20_000, 10**9):
            got = suffix_dedup.remove_repeats(docs.mapInArrow(shuffled, docs.schema), batch_bytes=size).collect()
            assert sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == sorted((str(r[0]), *w) for r, w in zip(rows, want))
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_equal_halves_of_identifiers_are_told_apart():
    u = np.array
    sent = [suffix_dedup.Sent(b, 1) for b in (0, 1)]
    for s, more in zip(sent, ([1, 2, 3], [2, 3, 4])):
        s.entries(3, u([7, 7, 7], np.uint64), u([10 + s.batch] * 3, np.uint64), u(more, np.uint64))
    rows = [r for s in sent for r in s.rows]
    met = suffix_dedup.meet((pa.scalar(0),), suffix_dedup.rows_table(rows))
    back = suffix_dedup.Returned(met.filter(pa.array([b == 1 for b in met.column("batch").to_pylist()])))
    same, low = back.found(3, u([7, 7, 7, 8], np.uint64), u([4, 3, 2, 2], np.uint64))
    assert same.tolist() == [False, True, True, False] and low[1] == low[2] == 10


def test_chunks_resist_shifts():
    r = random.Random(2)
    text = "".join(r.choice("abcdefgh ") for _ in range(5000))
    a, b = chunk_prints.chunks(text), chunk_prints.chunks("shift " + text)
    assert chunk_prints.likeness(a, b) > 0.95
    ends = chunk_prints.cuts(text.encode())
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(text) and sizes.max() <= chunk_prints.LARGEST and sizes[:-1].min() >= chunk_prints.SMALLEST
    assert chunk_prints.likeness(chunk_prints.chunks(""), chunk_prints.chunks(None)) == 1.0
    assert chunk_prints.likeness(a, chunk_prints.chunks("")) == 0.0


@pytest.mark.parametrize("size", [500, 10**9])
def test_next_documents_equal_brute_force(spark, rows, size):
    place = lambda r: (-(common.NO_ID if r[0] is None else r[0]),)
    order = sorted(sorted(rows, key=lambda r: r[1] or "", reverse=True), key=place)
    want = []
    for k, (i, t, *_) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        a, b, c = map(chunk_prints.chunks, (t, e, n))
        want.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), chunk_prints.written(a), chunk_prints.written(b), chunk_prints.likeness(a, b), chunk_prints.likeness(a, c)))
    got = [(str(r[0]), *r[1:]) for r in chunk_prints.with_next(frame(spark, rows), size).collect()]
    assert sorted(got) == sorted(want)


def test_poisson_counts(spark):
    rates = spark.createDataFrame([(0.2,), (3.0,), (900.0,)], "rate double").select("rate", mixing.poisson_cdf(F.col("rate"), F.lit(1400)).alias("cdf"))
    for r in rates.collect():
        p = np.diff([0.0, *r.cdf])
        assert abs(r.cdf[-1] - 1) < 1e-9 and abs(sum(k * x for k, x in enumerate(p)) - r.rate) < 1e-6 * r.rate
    rows = [(i, "x" * 100, "en", "big" if i % 10 else "small") for i in range(3000)]
    n = {r.source: r["count"] for r in mixing.replicate(frame(spark, rows)).groupBy("source").count().collect()}
    assert abs(n["big"] - 1500) < 150 and abs(n["small"] - 1500) < 300
    only = mixing.replicate(frame(spark, rows), {"small": 1.0}, budget=50_000).groupBy("source").count().collect()
    assert [r.source for r in only] == ["small"] and abs(only[0]["count"] - 500) < 120


@pytest.mark.parametrize("rate", [2500.0, 1e5, 5e9])
def test_large_poisson_counts_equal_the_summed_distribution(spark, rate):
    """The exact inverse, from the distribution summed outwards from its mode, differs in few numbers, and by one."""
    half = int(12 * rate**0.5)
    k = np.arange(int(rate) - half, int(rate) + half)
    logs = np.r_[0.0, np.cumsum(-np.log1p((k[1:] - rate) / rate))]
    p = np.exp(logs - logs.max())
    cdf = np.cumsum(p / p.sum())
    u = np.random.default_rng(7).random(20_000)
    want = k[0] + np.searchsorted(cdf, u, side="right")
    given = spark.createDataFrame([(float(x), rate, None) for x in u], "u double, rate double, cdf array<double>").withColumn("w", F.expr(mixing.normal_quantile("u")))
    got = np.array([r.n for r in given.select(mixing.counted(given).alias("n")).collect()])
    assert np.abs(got - want).max() <= 1 and (got != want).mean() < 1e-4 + 2 * 2.0**-52 * rate  # u itself has 52 bits


def test_sources_of_few_units(spark):
    """All copies of a document of a rare source come, made by several tasks; a rate beyond the range of ints isn't an error."""
    rows = [(k, "x" * 60_000, "en", "big") for k in range(2)] + [(7, "y", "en", "rare"), (8, None, "en", "none")]
    out = mixing.draws(frame(spark, rows), block=1000)
    n = {r.source: (r.n, r.copies, r.last) for r in out.groupBy("row.source").agg(F.count("*").alias("n"), F.count_distinct("copy").alias("copies"), F.max("copy").alias("last")).collect()}
    assert abs(n["rare"][0] - 40_000) < 5 * 200 and n["rare"][0] == n["rare"][1] == n["rare"][2]
    far = spark.createDataFrame([(0.5, 5e9, None)], "u double, rate double, cdf array<double>").withColumn("w", F.expr(mixing.normal_quantile("u")))
    assert far.select(mixing.counted(far)).first()[0] == 5_000_000_000


def test_columns_named_like_working_columns_are_kept(spark):
    names = ["row", "id", "u", "of", "rate", "cdf", "w", "n", "copy", "block", "order", "__source", "__u", "__base", "__all", "__sec", "__id", "__mark", "__first", "__same"]
    docs = spark.createDataFrame([(1, "a b c d e", "s", *names), (2, "token = abcdefgh1", "s", *names)], "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    for out in (mixing.replicate(docs, added=False), secret_scan.redact(docs), simhash.keep_first(docs)):
        assert out.columns == docs.columns and all(r[n] == n for r in out.collect() for n in names)


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(bpe.read_ranks(entries.vocabulary("byte_bpe_50k.tiktoken")))


def test_bpe_equals_tiktoken(spark, rows, merges):
    import public_tokenizers
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges.ranks, special_tokens={})
    want = []
    for i, t, *_ in rows:
        ids = np.array(own.encode_ordinary(t or ""), dtype="<u4").tobytes()
        want.append((str(i), len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    path = entries.vocabulary("byte_bpe_50k.tiktoken")
    got = [(str(r[0]), *r[1:]) for r in bpe.digests(frame(spark, rows), path, public_tokenizers.PATTERN).collect()]
    assert sorted(got) == sorted(want)
    both = bpe.decode(bpe.encode(frame(spark, rows), path, public_tokenizers.PATTERN), path)
    assert sorted(bytes(r.bytes) for r in both.collect()) == sorted((t or "").encode() for _, t, *_ in rows)


def test_both_splitters_agree():
    import public_tokenizers
    import regex

    assert bpe.PATTERN == public_tokenizers.PATTERN
    split, slow, r = bpe.splitter(bpe.PATTERN), regex.compile(bpe.PATTERN).findall, random.Random(1)
    for _ in range(4000):
        text = "".join(chr(r.choice([*range(9, 14), *range(28, 127), *range(0x80, 0x260), 0x2028, 0x4E00])) if r.random() < 0.5 else r.choice(" 's1aé\n_.") for _ in range(r.randint(1, 30)))
        assert split(text) == slow(text)


def test_replay_takes_lower_ranks_first():
    tokens = [bytes([i]) for i in range(256)] + [b"bc", b"abcd", b"ab", b"cd", b"abc"]  # abcd ranks below the parts it may come from
    lines = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens))
    m = bpe.Merges(lines)

    def greedy(word):
        parts = [bytes([c]) for c in word]
        while True:
            best = min(((m.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in m.ranks), default=None)
            if best is None:
                return [m.ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    r = random.Random(3)
    words = [bytes(r.choice(b"abcd") for _ in range(r.randint(1, 12))) for _ in range(500)]
    got = [np.frombuffer(x, dtype="<u4").tolist() for x in m.replay(words)]
    assert got == [[m.ranks[w]] if w in m.ranks else greedy(w) for w in words]


def components_by_force(rows):
    prints = []
    for _, t, *_ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        hs = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0)
    own = list(range(len(rows)))
    find = lambda x: x if own[x] == x else find(own[x])
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                own[max(find(a), find(b))] = min(find(a), find(b))
    ids = [common.NO_ID if i is None else i for i, *_ in rows]
    low = {}
    for a in range(len(rows)):
        low[find(a)] = min(low.get(find(a), common.NO_ID), ids[a])
    return sorted((str(rows[a][0]), format(prints[a], "016x"), str(None if low[find(a)] == common.NO_ID else low[find(a)])) for a in range(len(rows)))


@pytest.mark.parametrize("options", [{}, {"dense": 3}, {"many": 5}])
def test_near_duplicates_equal_brute_force(spark, rows, options):
    got = simhash.near_duplicates(frame(spark, rows), **options).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == components_by_force(rows)


def test_dense_keys_in_many_batches_equal_brute_force(spark):
    """Runs that go on over batches, dense ones among them, give the components of all pairs."""
    r, batch = random.Random(6), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    prints = sorted({(r.choice((0, 5 << 40, 77 << 20)) ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 3)))) & (2**63 - 1) for _ in range(400)})
    own = {p: p for p in prints}
    find = lambda x: x if own[x] == x else find(own[x])
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 4:
                own[max(find(a), find(b))] = min(find(a), find(b))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        for dense in (4, 60, 10**6):
            found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), dense=dense)
            got = {x.node: x.root for x in components.components(found).collect()}
            assert got == {p: find(p) for p in prints if sum(find(q) == find(p) for q in prints) > 1}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_keep_first_keeps_whole_rows(spark, rows):
    kept = simhash.keep_first(frame(spark, rows)).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    want = {int(c) for i, _, c in components_by_force([r for r in rows if r[0] is not None])}
    assert len(ids) == len(set(ids)) and set(ids) == want and kept[0].key == "x"


def test_near_copies_dont_displace_texts_of_their_id(spark):
    copy, own = "a " + " ".join(f"w{k}" for k in range(80)), "z " + " ".join(f"v{k}" for k in range(80))
    kept = simhash.keep_first(frame(spark, [(1, copy, "en", "a"), (5, copy, "en", "a"), (5, own, "en", "a"), (5, own, "en", "a"), (None, own, "en", "a")])).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, copy), (5, own)]


def test_texts_are_moved_once(spark, rows):
    plan = simhash.keep_first(frame(spark, rows))._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().apply(0)
    assert [a.name() for a in (plan.left().output().apply(i) for i in range(plan.left().output().size()))] == ["row", "id", "mark"]


def test_columns_of_keep_first_have_any_name(spark, rows):
    docs = frame(spark, rows)
    named = docs.withColumnsRenamed({"text": "row", "doc_id": "mark"})
    assert sorted(map(str, map(tuple, simhash.keep_first(named, "mark", "row").collect()))) == sorted(map(str, map(tuple, simhash.keep_first(docs).collect())))


def test_components(spark):
    r = random.Random(4)
    edges = [(a, a + 1) for a in range(100, 160)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)] + [(1, 1), (None, 2)]
    own = {}
    find = lambda x: x if own.setdefault(x, x) == x else find(own[x])
    for a, b in edges:
        if a is not None and a != b:
            own[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in own}


def pii_by_force(t):
    out = []
    add = lambda kind, m: out.append(f"{kind}:{m.start()}:{m.end()}")
    n = lambda m: re.sub("[^0-9]", "", m[0])
    luhn = lambda d: sum((x := int(c) * (1 + i % 2)) - 9 * (x > 9) for i, c in enumerate(reversed(d))) % 10 == 0
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        add("email", m)
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            add("ip", m)
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        if 13 <= len(n(m)) <= 19 and luhn(n(m)):
            add("card", m)
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(n(m)) <= 15:
            add("phone", m)
    return out


def noise(alphabet, n, seed):
    r = random.Random(seed)
    return [(k, "".join(r.choice(alphabet) for _ in range(r.randint(0, 60))), "en", "a") for k in range(n)]


def test_personal_data_equals_brute_force(spark, rows):
    alphabet = ["1", "4", "0", "255", ".", ".", " ", "-", "+", "@", "a", "b.c", "x_", "%", "(", ")", "😀", "4111111111111111", "10.0.0.1", "a@b.co", ":", "é"]
    long = [(9001, "a@" + "b." * 40_000 + "c", "en", "a"), (9002, "1 " * 40_000, "en", "a"), (9003, "x" * 90_000 + "@", "en", "a")]
    own = [r for r in rows if r[0] is not None and r[0] != 10] + [(5000 + i, *rest) for i, *rest in noise(alphabet, 1500, 3)] + long
    got = {r.doc_id: r for r in pii_votes.find(frame(spark, own)).collect()}
    for i, t, *_ in own:
        want = pii_by_force(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert set(want) <= set(got[i].spans.split(","))


def test_votes_and_classifier():
    good = {"kind": "phone", "v0": 1, "v1": 1, "v2": 1, "v3": 1, "v4": 0, "glued": False, "runs_on": False, "parted": True, "n": 50}
    bad = good | {"kind": "weak_card", "v0": 0, "v1": -1, "v2": -1, "v3": 0, "v4": -1, "n": 80}
    prior, chance, post = pii_votes.reliabilities([good, bad])
    assert post[0] > 0.95 and post[1] < 0.05 and prior["phone"] > prior["weak_card"]
    assert all(abs(sum(c[v, y] for v in (-1, 0, 1)) - 1) < 1e-9 for c in chance for y in (0, 1))
    weights = pii_votes.classifier([good, bad], post)
    assert sum(weights[f] for f in pii_votes.features(good)) > 0 > sum(weights[f] for f in pii_votes.features(bad))


def test_looser_spans_need_votes(spark):
    shown = [(k, f"Call us: phone ({k % 7 + 2}15) 555-{1000 + k} today", "en", "a") for k in range(60)] + [(100 + k, f"serial part no 9{k:02d}1-0000-0000-0001 version {k}", "en", "a") for k in range(60)]
    out = {r.doc_id: r.spans for r in pii_votes.find(frame(spark, shown + [(500, "mail a.b@c.com, phone +1 212 555 0100", "en", "a")])).collect()}
    assert all(out[k].startswith("weak_phone:") for k in range(60)) and not any("weak" in out[100 + k] for k in range(60))


def test_native_operators_run_no_python(spark):
    for df in (secret_scan.scan(frame(spark, EDGES)), secret_scan.redact(frame(spark, EDGES)), pii_votes.find(frame(spark, EDGES), weights={"kind=ssn": 1.0})):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def secrets_by_force(t):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        out += [(m.start(), 0, f"assign:{m.start()}:{m.end()}")] * (len(m[2]) >= 8)
    for m in re.finditer(r"AKIA[A-Z0-9]+", t):
        out += [(m.start(), 1, f"access:{m.start()}:{m.end()}")] * (len(m[0]) >= 16)
    for m in re.finditer(r"[0-9a-f]+", t):
        out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}")] * (len(m[0]) >= 32)
    return ",".join(x for _, _, x in sorted(out))


def test_base_secrets_equal_brute_force(spark):
    alphabet = ["token", "PassWord", "api_key", "apikey", '"', "'", " ", "=", ":", "abcdef12", "0" * 32, "AKIAABCDEFGHIJ12", "x", "-", "é", "😀", "f", "AKIA"]
    own = noise(alphabet, 1500, 8)
    got = {r.doc_id: r for r in secret_scan.scan(frame(spark, own)).collect()}
    assert all(got[i].base_sha256 == hashlib.sha256(secrets_by_force(t).encode()).hexdigest() for i, t, *_ in own)


def test_weak_parts_need_company(spark):
    weak = "Zm9vYmFyQmF6UXV4MTIzNDU2Nzg5MA"
    texts = {1: f"blob {weak} alone", 2: f"user: deploy.bot and {weak}", 3: f"user: deploy.bot {'x ' * 200}{weak}", 4: "see https://docs.example.org only", 5: f"https://db.example.org user: root {weak}"}
    rows = {r.doc_id: r for r in secret_scan.scan(frame(spark, [(i, t, "en", "a") for i, t in texts.items()])).collect()}
    kinds = {i: [s.split(":")[0] for s in r.spans.split(",") if s] for i, r in rows.items()}
    assert kinds == {1: [], 2: ["identifier", "secret"], 3: [], 4: [], 5: ["endpoint", "identifier", "secret"]}
    clean = {r.doc_id: r.text for r in secret_scan.redact(frame(spark, [(i, t, "en", "a") for i, t in texts.items()])).collect()}
    assert clean[1] == texts[1] and weak not in clean[2] and clean[2] == "[SECRET] and [SECRET]"


def test_parts_dont_complement_themselves(spark):
    weak = "Zm9vYmFyQmF6UXV4MTIzNDU2Nzg5MA"
    url = f"see https://docs.example.org/{weak}/page for more"
    texts = {1: url, 2: f"login: {weak}", 3: f"https://db.example.org {weak}"}
    clean = {r.doc_id: r.text for r in secret_scan.redact(frame(spark, [(i, t, "en", "a") for i, t in texts.items()])).collect()}
    assert clean == {1: url, 2: texts[2], 3: "https://db.example.org [SECRET]"}
    spans = {r.doc_id: r.spans for r in secret_scan.scan(frame(spark, [(i, t, "en", "a") for i, t in texts.items()])).collect()}
    assert spans[1] == spans[2] == "" and spans[3].startswith("secret:")


def test_spans_meet_as_by_brute_force(spark):
    r = random.Random(9)
    pairs = []
    for n in [0, 1, 2, 5, 30, 700]:
        for m in [0, 1, 3, 40, 700]:
            make = lambda k: [(a, a + r.randint(1, 9)) for a in (r.randint(0, 6 * k) for _ in range(k))]
            pairs.append((len(pairs), make(n), make(m)))
    kind = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame(pairs, f"k int, a {kind}, b {kind}")
    got = df.select("k", spans.near(F.col("a"), F.col("b"), 4).alias("near"), spans.apart_from(F.col("a"), F.col("b")).alias("apart")).collect()
    for g, (_, a, b) in zip(sorted(got), pairs):
        assert [tuple(s) for s in g.near] == [s for s in a if any((0 <= s[0] - o[1] <= 4) or (0 <= o[0] - s[1] <= 4) for o in b)]
        assert [tuple(s) for s in g.apart] == [s for s in a if not any(s[0] < o[1] and o[0] < s[1] for o in b)]


def test_texts_with_many_spans_take_linear_time(spark):
    import time

    text = "é token = abcdefgh12 https://a.example/x user: root " * 20_000 + "😀" * 3000
    rows = frame(spark, [(1, text, "en", "a")]).repartition(1)
    began = time.perf_counter()
    row = secret_scan.scan(rows).first()
    clean = secret_scan.redact(rows).first().text
    assert row.n_assign == 20_000 and row.spans.count("endpoint") == row.spans.count("identifier") == 20_000
    assert clean == "é [SECRET] [SECRET] [SECRET] " * 20_000 + "😀" * 3000
    mails = pii_votes.find(frame(spark, [(1, "call a.b@c.com or +1 (212) 555-0100, 10.0.0.1; " * 10_000, "en", "a")])).first()
    assert mails.n_email == mails.n_ip == mails.n_phone == 10_000
    assert time.perf_counter() - began < 90  # by pairs it would take hours


def test_segmentations_are_summed():
    r = random.Random(2)
    pieces = sorted({"".join(r.choice("▁abcé") for _ in range(r.randint(1, 4))) for _ in range(60)})
    chances = np.random.default_rng(1).random((len(pieces) + 1, 2))
    words = ["".join(r.choice("abcéz") for _ in range(r.randint(1, 9))) for _ in range(200)]
    got = langid.Lattice(words, langid.Pieces(pieces)).scores(chances)
    for k in range(2):
        want = [langid.reference_score("▁" + w, {p: chances[i, k] for i, p in enumerate(pieces)}, chances[-1, k]) for w in words]
        assert np.allclose(got[:, k], want)
    counts = np.ones(len(words))
    uses, whole = langid.Lattice(words, langid.Pieces(pieces)).expected(chances[:, 0], counts)
    assert abs(whole - got[:, 0].sum()) < 1e-6
    letters = sum(u * len(p) for u, p in zip(uses, [*pieces, "x"]))
    assert abs(letters - sum(len(w) + 1 for w in words)) < 1e-6  # expected pieces cover each word


def test_long_words_are_summed_whole():
    """Logarithms give the sums of the plain way, and words are never cut."""
    r = random.Random(3)
    pieces = sorted({"".join(r.choice("▁abc") for _ in range(r.randint(1, 4))) for _ in range(40)})
    chances = np.random.default_rng(1).random((len(pieces) + 1, 3)) / 9
    words = ["".join(r.choice("abcz") for _ in range(r.randint(1, 28))) for _ in range(60)]
    plain, index = langid.Lattice(words, langid.Pieces(pieces)), langid.Pieces(pieces)
    mixed = langid.Lattice([*words, "abcabz" * 700], index)  # one long word among them: all by logarithms
    assert np.allclose(mixed.scores(chances)[:-1], plain.scores(chances)) and np.isfinite(mixed.scores(chances)).all()
    a, b = plain.expected(chances[:, 0], np.ones(60)), langid.Lattice([*words, "a" * 40], index).expected(chances[:, 0], np.r_[np.ones(60), 1e-300])
    assert np.allclose(a[0], b[0]) and abs(a[1] - b[1]) < 1e-6
    split = [i for own in langid.blocks([*words, "x" * 500_000, "y" * 31]) for i in own]
    assert sorted(split) == list(range(62))


def test_fit_and_predict_equal_brute_force(spark):
    """Expectation-maximisation by listing all segmentations, over a tiny vocabulary."""
    r = random.Random(4)
    pieces = sorted({"▁", "a", "b", "▁a", "ab", "ba", "bab", "▁ba"})
    text = {"p": lambda: " ".join("ab" * r.randint(1, 2) for _ in range(6)), "q": lambda: " ".join("ba" * r.randint(1, 3) + "z" * r.randint(0, 1) for _ in range(6))}
    rows = [(i, text["pq"[i % 2]](), "pq"[i % 2], "a") for i in range(60)]
    model = langid.fit(frame(spark, rows), pieces, rounds=4, gain=0.0)

    def ways(word):
        if not word:
            yield []
        for j in range(1, len(word) + 1):
            if word[:j] in pieces or (j == 1 and word[0] not in pieces):
                for rest in ways(word[j:]):
                    yield [pieces.index(word[:j]) if word[:j] in pieces else len(pieces), *rest]

    import zlib

    learned = [(t, lang) for i, t, lang, _ in rows if zlib.crc32(str(i).encode()) % 5]
    chance = {lang: [1 / (len(pieces) + 1)] * (len(pieces) + 1) for lang in "pq"}
    for _ in range(4):
        for lang in "pq":
            counts = [langid.SMOOTH] * (len(pieces) + 1)
            for t in (t for t, own in learned if own == lang):
                for word in t.split():
                    each = [(way, float(np.prod([chance[lang][p] for p in way]))) for way in ways("▁" + word)]
                    whole = sum(p for _, p in each)
                    for way, p in each:
                        for piece in way:
                            counts[piece] += p / whole
            chance[lang] = [c / sum(counts) for c in counts]
    assert np.allclose(model.chances, np.array([chance["p"], chance["q"]]).T)
    for row in langid.predict(frame(spark, rows), model).collect():
        own = dict((i, t) for i, t, *_ in rows)[row.doc_id]
        log = {lang: sum(np.log(sum(np.prod([chance[lang][p] for p in way]) for way in ways("▁" + w))) for w in own.split()) for lang in "pq"}
        best = max(sorted(log), key=log.get)
        assert row.lang_pred == best and abs(row.score - 1 / sum(np.exp(x - log[best]) for x in log.values())) < 1e-6
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)


def test_words_are_letters_with_their_marks():
    assert langid.words_of("हिन्दी भाषा में 12") == ["हिन्दी", "भाषा", "में"]
    assert langid.words_of("Cafe\u0301 au_lait") == ["cafe\u0301", "au", "lait"]
    assert langid.words_of("❤\ufe0f 5 \u0301") == langid.words_of("½ ² ① Ⅷ ٣ 〇 x".replace("x", "")) == []
    assert langid.words_of("x²\u0301y") == ["x", "\u0301y"] and langid.words_of("m² of " + "a" * 90) == ["m", "of", "a" * 90]
    kinds = {chr(c): unicodedata.category(chr(c)) for c in range(0x110000) if not 0xD800 <= c < 0xE000}
    assert all(langid.words_of(f"a{c}b") == [f"a{c}b".lower()] for c, k in kinds.items() if k[0] == "M")
    assert not any(langid.words_of(c) for c, k in kinds.items() if k[0] == "N")
    assert all(langid.words_of(c) for c, k in kinds.items() if k[0] == "L" and k != "Lm")


def test_languages_are_told(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(None, "the 12"), (-1, None), (-2, ""), (-3, "12 :-)"), (-4, "½ ² ① Ⅷ")], "doc_id long, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    model = langid.fit(docs, entries.vocabulary("piece_bpe_32k.model"), size=60)
    out = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(out) > 150 and sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out) and all(0 <= r.score <= 1 for r in out)
    odd = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(extra, model).collect()}
    assert odd[-1] == odd[-2] == odd[-3] == odd[-4] == ("und", 0.0) and odd[None][0] in model.languages
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4


def test_texts_with_letters_stay_without_labels(spark):
    docs = frame(spark, [(1, "plain words", None, "a"), (2, "12 :-)", None, "a"), (3, None, None, "a"), (None, "é", None, "a")])
    kept = langid.keep_known(docs, langid.fit(docs, entries.vocabulary("piece_bpe_32k.model")))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, None}


def test_quality_measures_of_hand_made_texts():
    assert quality.measures("") == (0, 0, 0, 0, 0)
    assert quality.measures("a b c\na b c\n\n# a b c") == (10, 10, 1, 1, 9)
    assert quality.measures("x x x x") == (4, 4, 0, 0, 4)
    assert quality.measures("a\xa0b c") == (2, 4, 0, 0, 0)


def test_lines_of_a_host(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, f"Home | About\n{body(i)}", "en", "hot") for i in range(30)] + [(100 + i, f"Home | About\n{body(i + 50)}", "en", f"s{i}") for i in range(5)] + [(200 + i, "Home | About\n" * 40 + body(i + 90)[:200], "en", "hot") for i in range(3)]
    out = {r.doc_id: r for r in quality.line_rules(frame(spark, rows)).collect()}
    assert all(out[i].kept and out[i].n_words_removed == 3 for i in range(30)) and all(out[100 + i].n_words_removed == 0 for i in range(5))
    assert not any(out[200 + i].kept for i in range(3))


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0}])
def test_lines_are_removed_from_texts(spark, options):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, f"Home |\tAbout\n{body(i)}\n\n  home  | ABOUT \nend {i}", "en", None if i % 2 else "hot") for i in range(40)] + [(40 + i, t, "en", s) for i, (t, s) in enumerate([("Home | About\nx", "cold"), (None, "hot"), ("", "hot"), ("Home | About", "hot")])] + [(None, f"home | about\n{k}", "en", "hot") for k in range(2)]
    out = quality.line_rules(frame(spark, rows), **options).collect()
    want = [(i, f"{body(i)}\n\nend {i}", 6) for i in range(40)] + [(40, "Home | About\nx", 0), (41, None, 0), (42, "", 0), (43, "", 3), (None, "0", 3), (None, "1", 3)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text, r.n_words_removed)) for r in out)


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "secret_scan", "source_mix", "bpe"]
    docs = entries.documents(spark, SF)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    one = stages["near_dedup"](spark, kept, SF)
    groups = entries.QUERIES["op7_simhash_index"](spark, SF)
    assert sorted(r.doc_id for r in one.collect()) == sorted(r.component_id for r in groups.select("component_id").distinct().collect())
    clean = stages["secret_scan"](spark, one, SF)
    spans = secret_scan.scan(clean).where("n_assign + n_access + n_hex > 0").count()
    assert clean.columns == docs.columns and clean.count() == one.count() and spans == 0
    mixed = stages["source_mix"](spark, clean, SF)
    assert mixed.columns == docs.columns
    assert corpus_pipeline.run(spark, SF).count() == mixed.count()
