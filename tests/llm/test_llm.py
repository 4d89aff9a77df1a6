"""Each operator against brute force, an exact round trip or held-out labels, and on awkward rows."""

import base64
import collections
import gzip
import hashlib
import itertools
import re
import zipfile
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import fair_mix, fast_tokens, harmonic_pack, hashed, histogram_sort, importance_resample, jaccard_join, preference_format, queries, robust_outliers, token_rollup, vp_tree, warc_zip

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = " \t\n\x0b\x0c\r"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def docs_of(spark, texts, source="a"):
    return spark.createDataFrame([(i, t, "en", source, None) for i, t in enumerate(texts)], DOCS)


AWKWARD = [None, "", " \n\t ", "one", "Ünïcode wörds hier", "x" * 5000, "a b c d e " * 400, "same text here for all", "same text here for all", "semi; colon, \x1c odd"]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(AWKWARD)]
    rows += [(None, "no id here", None, None, None), (None, None, None, None, None), (7, "same text here for all", "en", "a", 1)]
    extra = ["shard", "slot", "size", "kept", "score", "copies", "target", "taken", "_h", "_s", "n_words"]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("clash") for c in extra})


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    found = duck.sql(queries.ORACLE_SQL[name])
    at = [found.columns.index(c) for c in cols]
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)


# 1


def test_rollup_signs_replays_and_compaction(spark, tmp_path):
    fields = "op string, source string, lang string, tokenizer string, tokens long, old_source string, old_lang string, old_tokenizer string, old_tokens long"
    batch = lambda *r: token_rollup.changes(spark.createDataFrame(list(r), fields))
    ins = lambda n, s="a": ("insert", s, "en", "v1", n, None, None, None, None)
    r = token_rollup.Rollup(spark, f"file://{tmp_path}/r")
    assert r.totals().count() == 0
    assert r.commit("1", batch(ins(5), ins(7), ins(None, None)))
    assert not r.commit("1", batch(ins(100)))
    assert r.commit("2", batch(("revise", "a", "en", "v2", 6, "a", "en", "v1", 5), ("what", "a", "en", "v1", 9, None, None, None, None)))
    r.compact()
    assert not r.commit("2", batch(ins(100)))
    assert r.commit("3", batch(("delete", "a", "en", "v1", 7, None, None, None, None)))
    assert r.commit("4", spark.createDataFrame([], "source string, lang string, tokenizer string, docs long, tokens long"))
    got = {(x.source, x.tokenizer): (x.docs, x.tokens) for x in r.totals().collect()}
    assert got == {("a", "v2"): (1, 6), (None, "v1"): (1, 0)}
    # a writer that was lost leaves an attempt, which counts for nothing
    (tmp_path / "r" / "attempt=x").mkdir()
    assert r.commit("5/ é=%", batch(ins(1, "z"))) and not r.commit("5/ é=%", batch(ins(1, "z"))) and r.totals().where("source = 'z'").first().tokens == 1
    assert r.live() == ["3", "4", "5/ é=%"]
    before = sorted(map(tuple, r.totals().collect()), key=repr)
    # a batch that is committed between a compaction's listing and its end is in none of its parts
    listing = r._listing()
    assert r.commit("6", batch(ins(9, "y")))
    assert r._fold(*listing) and not r._fold(*listing)
    assert r.live() == ["6"] and r.totals().where("source = 'y'").first().tokens == 9
    r.purge()
    assert sorted(map(tuple, r.totals().where("source <> 'y' or source is null").collect()), key=repr) == before
    assert not r.commit("2", batch(ins(100))) and not r.commit("6", batch(ins(100))) and sorted(n for n in r._names() if n[0] == "b") == ["base=00000002", "batch=6"]


def test_counts_of_a_tokenizer(spark, awkward, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path := harmonic_pack.default_tokenizer())
    rows = token_rollup.token_counts(awkward, path, ["doc_id", "source", "lang", "text", "tokens"] if "tokens" in awkward.columns else ["doc_id", "source", "lang", "text"]).collect()
    assert len(rows) == awkward.count() and all(r.tokens == len(whole.encode(r.text or "", add_special_tokens=False).ids) for r in rows)
    counted = token_rollup.token_counts(awkward, path, ["source", "lang"]).withColumns({"op": F.lit("insert"), "tokenizer": F.lit("bpe")} | {f"old_{k}": F.lit(None).cast("string") for k in token_rollup.KEYS} | {"old_tokens": F.lit(None).cast("long")})
    rollup = token_rollup.Rollup(spark, f"file://{tmp_path}/r")
    rollup.commit("1", token_rollup.changes(counted))
    assert rollup.totals().agg(F.sum("tokens")).first()[0] == sum(r.tokens for r in rows)


# 2


def test_preferences(spark):
    fields = "pair_id long, turn long, role string, text string"
    a = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "q"), (3, 0, None, None), (3, 0, None, None), (None, 0, "user", "x"), (4, 0, "user", "u")], fields)
    b = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", "why"), (2, 0, "user", "q"), (3, 0, "", "")], fields)
    got = {r.pair_id: r for r in preference_format.format_preferences(a, b).collect()}
    assert set(got) == {1, 2, 3}
    r = got[1]
    assert (r.n_prompt_turns, r.prompt) == (1, "<|start|>user\nhi<|end|>\n")
    assert r.chosen == "<|start|>assistant\nyes<|end|>\n" and r.rejected.endswith("<|start|>user\nwhy<|end|>\n")
    marked = lambda text, spans: "".join(text[s : s + x.length] for s, x in zip(itertools.accumulate([0] + [y.length for y in spans]), spans) if x.mask)
    assert marked(r.chosen, r.chosen_spans) == "yes<|end|>\n" and marked(r.rejected, r.rejected_spans) == "no<|end|>\n"
    assert got[2].chosen == got[2].rejected == "" and got[2].n_prompt_turns == 1 and got[3].n_prompt_turns == 1
    assert preference_format.format_preferences(a.limit(0), b).count() == 0
    odd = a.unionByName(spark.createDataFrame([(8, 0, "user", "x" * 200_000), (8, 0, "user", "w")], fields)).withColumns({c: F.lit("clash") for c in ("c", "r", "n", "t", "_all", "prompt")})
    clash = {r.pair_id: r for r in preference_format.format_preferences(odd, odd).collect()}
    assert clash[8].prompt == "<|start|>user\nw<|end|>\n" and clash[1].n_prompt_turns == 2 and clash[1].chosen == ""
    long = {r.pair_id: r for r in preference_format.format_preferences(odd.where("length(text) > 1000"), b.withColumn("pair_id", F.lit(8).cast("long")).limit(1)).collect()}
    assert long[8].chosen_spans[1].length == 200_000 + 8 and long[8].n_prompt_turns == 0


# 3


@pytest.mark.parametrize("zip64", [False, True])
def test_archive_round_trip(spark, tmp_path, zip64):
    html = [b"<p>a</p>", None, b"", b"<p>a</p>", "é\r\n\r\nx".encode(), b"<p>a</p>", b"z" * 300_000]
    rows = [(i + 10, f"http://h/é {i}\n", h) for i, h in enumerate(html)] + [(None, None, b"<p>a</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html binary").withColumn("payload", F.lit("clash"))
    made = warc_zip.write_packages(pages.repartition(3), f"file://{tmp_path}/w", package_bytes=200, zip64=zip64)
    got = {r.page_id: r for r in warc_zip.read_records(made).collect()}
    assert len(got) == len(rows) and made.agg(F.sum("records")).first()[0] == len(rows)
    first = {}
    for i, h in enumerate(html):
        body = h or b""
        f = first.setdefault(body, i + 10)
        r = got[i + 10]
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if f == i + 10 else ("revisit", f))
        assert r.payload == (body if f == i + 10 else None)
    assert (got[None].record_type, got[None].refers_to) == ("revisit", 10)
    for r in made.collect():
        z = zipfile.ZipFile(r.package.removeprefix("file://"))
        assert z.testzip() is None and all(i.compress_type == 0 for i in z.infolist())
    none = warc_zip.write_packages(pages.limit(0), f"file://{tmp_path}/e")
    assert warc_zip.read_records(none).count() == 0


def test_least_revisit(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "aaaa"), (4, "u", "aaaa")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc_zip.read_records(warc_zip.write_packages(pages, f"file://{tmp_path}/w", 3), False).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_one_response_of_repeated_ids(spark, tmp_path):
    rows = [(3, "u", "x")] * 3000 + [(3, "v", "x"), (3, "v", "y"), (3, "w", "y"), (5, "u", "x"), (None, "u", "y"), (4, None, "z"), (4, None, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = collections.Counter((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc_zip.read_records(warc_zip.write_packages(pages, f"file://{tmp_path}/w"), False).collect())
    x, y, z = (base64.b32encode(hashlib.sha1(c).digest()).decode() for c in (b"x", b"y", b"z"))
    assert got == {(3, x, "response", None): 1, (3, x, "revisit", 3): 3000, (3, y, "response", None): 1, (3, y, "revisit", 3): 1, (5, x, "revisit", 3): 1, (None, y, "revisit", 3): 1, (4, z, "response", None): 1, (4, z, "revisit", 4): 1}


def test_package_of_another_writer(spark, tmp_path):
    """Several archives, a plain and a packed index, other members, and a signature in the comment."""
    record = lambda i: warc_zip._record(i, f"http://h/{i}", b"body %d" % i, warc_zip.digest32(b"body %d" % i), len(b"body %d" % i), None, False)
    line = lambda name, at, n: f'org,h)/ 20200101 {{"url": "u", "filename": "{name}", "offset": "{at}", "length": {n}}}\n'.encode()
    one, two, three = record(1), record(2), record(3)
    with zipfile.ZipFile(tmp_path / "x.wacz", "w", zipfile.ZIP_STORED) as out:
        out.writestr("datapackage.json", b"{}", zipfile.ZIP_DEFLATED)
        out.writestr("archive/a.warc.gz", one + two)
        out.writestr("archive/b.warc.gz", three)
        out.writestr("indexes/index.cdx.gz", gzip.compress(b"!meta {}\n" + line("a.warc.gz", 0, len(one))) + gzip.compress(line("a.warc.gz", len(one), len(two))))
        out.writestr("indexes/more.cdxj", line("b.warc.gz", 0, len(three)).rstrip())
        out.writestr("indexes/index.idx", b"org,h)/ 0 {}")
        out.comment = b"x PK\x05\x06 and more of a comment than an end record has"
    packages = spark.createDataFrame([(f"file://{tmp_path}/x.wacz",)], "package string")
    assert sorted((r.page_id, r.payload) for r in warc_zip.read_records(packages).collect()) == [(i, b"body %d" % i) for i in (1, 2, 3)]


def test_directory_read_by_another_zip_writer(tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a/b.txt", b"hello")
        z.comment = b"a comment"
    raw = (tmp_path / "x.zip").read_bytes()
    method, at, size = warc_zip.read_directory(lambda a, n: raw[a : a + n], len(raw))["a/b.txt"]
    assert method == 0 and raw[at : at + size] == b"hello"
    with pytest.raises(ValueError):
        warc_zip.read_directory(lambda a, n: b"x" * n, 100)


# 4


def check_shards(rows, shards, slack):
    size = collections.Counter()
    for s in range(shards):
        mine = sorted(r.slot for r in rows if r.shard == s)
        assert mine == list(range(len(mine)))
        size[s] = sum(r.size for r in rows if r.shard == s)
    assert max(size.values()) - min(size[s] for s in range(shards)) <= slack


def test_histogram_sort_cuts_a_hot_group(spark):
    texts = ["hot text"] * 3000 + [f"text {i} " * (i % 9) for i in range(1500)]
    rows = histogram_sort.shard_documents(docs_of(spark, texts).repartition(5), 16).withColumn("size", F.octet_length("text") + 1).collect()
    assert len(rows) == len(texts) and len({r.doc_id for r in rows}) == len(texts)
    check_shards(rows, 16, 250)
    held = collections.Counter((r.text, r.shard) for r in rows)
    assert sum(n > 0 for (t, _), n in held.items() if t == "hot text") >= 4


def test_histogram_sort_cuts_equal_rows(spark):
    rows = [(7, "the same row again and again", "en", "a", None)] * 4000 + [(100 + i, f"row {i}", "en", "a", None) for i in range(1000)]
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    out = histogram_sort.shard_documents(df, 16).withColumn("size", F.octet_length("text") + 1).collect()
    assert collections.Counter((r.doc_id, r.text) for r in out) == collections.Counter(r[:2] for r in rows)
    check_shards(out, 16, 100)


def test_histogram_sort_awkward(spark, awkward):
    rows = histogram_sort.shard_documents(awkward, 4).collect()
    assert len(rows) == awkward.count() and {r.shard for r in rows} <= set(range(4))
    assert histogram_sort.shard_documents(awkward.limit(0), 4).count() == 0
    out = {r.doc_id: r for r in queries.QUERIES["op4_histogram_sort"](spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        assert (out[r.doc_id].size, out[r.doc_id].text_crc32) == (len(r.text.encode()) + 1, zlib.crc32(r.text.encode()))
    check_shards(list(out.values()), 16, 2 * max(r.size for r in out.values()))


# 5


@pytest.mark.parametrize("base", ["sf0.01", "sf0.1"])
def test_resampling_keeps_good_and_drops_bad(spark, base):
    kept = {r.doc_id for r in queries.QUERIES["op5_importance_resample"](spark, f"/root/testdata/{base}").collect()}
    labels = spark.read.parquet(f"/root/testdata/{base}/labels.parquet").collect()
    good = [r.doc_id for r in labels if r.quality == 1 and not r.toxic]
    bad = [r.doc_id for r in labels if r.quality == 0]
    assert sum(d in kept for d in good) >= 0.97 * len(good) and sum(d in kept for d in bad) <= 0.25 * len(bad)


def test_resampling_against_brute_force(spark, small):
    """Models, weights and the draw, counted in dictionaries."""
    docs, labels = small.limit(90), spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = docs.collect()
    target = importance_resample.labelled(labels)[0]
    grams = {}
    for r in rows:
        tokens = re.findall(r"(?:[^\W_])+|(?:[^\w\x09-\x0D ]|_)+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        h = hashed.hash_strings(pa.array(tokens, pa.string())) if tokens else np.empty(0, np.uint64)
        both = np.concatenate([h, hashed.window_hashes(h, 2)])
        grams[r.doc_id] = collections.Counter((both % np.uint64(importance_resample.BUCKETS)).tolist())
    raw, good = collections.Counter(), collections.Counter()
    for d, c in grams.items():
        raw.update(c)
        good.update(c if d in target else {})
    a = importance_resample.PRIOR
    want = {}
    for d, c in grams.items():
        mine = c if d in target else {}
        scale = (good.total() - sum(mine.values() if mine else [])) / max(1, raw.total() - c.total())
        want[d] = sum(n * np.log((good[b] - (n if mine else 0) + a) / (scale * (raw[b] - n) + a)) for b, n in c.items())
    got = importance_resample.resample(docs, labels, ["doc_id"], k=90).collect()
    assert len(got) == 90 and all(abs(r.log_weight - want[r.doc_id]) < 1e-6 * (1 + abs(want[r.doc_id])) for r in got)
    best = {r.doc_id for r in sorted(got, key=lambda r: -r.score)[:37]}
    assert {r.doc_id for r in importance_resample.resample(docs, labels, k=37).collect()} == best


def test_kth_greatest(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(0, 1e3, 30_000), np.full(20_000, 5.0), [1e9]])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    for k in (1, 2, 777, 20_000, len(v)):
        assert importance_resample.kth_greatest(df, k) == np.sort(v)[-k]


def test_resampling_awkward(spark, awkward):
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, None), (6, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert importance_resample.resample(awkward, labels).count() <= awkward.count()
    none = importance_resample.resample(awkward, labels.limit(0))
    assert none.count() == awkward.count()
    assert importance_resample.resample(awkward.limit(0), labels).count() == importance_resample.resample(awkward.limit(0), labels, k=3).count() == 0
    assert importance_resample.resample(awkward, labels, k=0).count() == 0 and importance_resample.resample(awkward, labels, k=99).count() == awkward.count()


# 6


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = budget - sum(2 * sizes[s] for s in full)
        total = sum(w[s] for s in sizes if s not in full)
        more = {s for s in sizes if s not in full and left * w[s] / total > 2 * sizes[s]}
        if not more:
            return {s: 2.0 * sizes[s] if s in full else left * w[s] / total for s in sizes}
        full |= more


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(["w"] * int(n)), "en", s, None) for i, (n, s) in enumerate(zip(rng.integers(0, 40, 3000), rng.choice(["a", "b", "c", "d", None], 3000, p=[0.6, 0.2, 0.1, 0.02, 0.08]).tolist()))]
    df = spark.createDataFrame(rows, DOCS)
    out = fair_mix.fair_mix(df.repartition(7)).collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in out:
        assert r["size"] == len(words(r.text)) and r.taken in (0, r["size"], 2 * r["size"])
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
    want = brute_targets(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * want[r.source]
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes) and sum(taken.values()) <= 1.5 * sum(sizes.values())
    again = fair_mix.fair_mix(df.coalesce(1)).collect()
    assert {r.doc_id: r.taken for r in out} == {r.doc_id: r.taken for r in again}
    copies = fair_mix.mixed_documents(df)
    assert copies.columns == df.columns and copies.count() == sum(r.copies for r in out)


def test_mix_of_equal_rows(spark):
    rows = [(7, "the same row again and again " * 3, "en", "a", None)] * 4000 + [(100 + i, f"row {i} of few words", "en", "ab"[i % 2], None) for i in range(1000)]
    df = spark.createDataFrame(rows, DOCS)
    out = fair_mix.fair_mix(df.repartition(6)).collect()
    assert len(out) == len(rows)
    sizes, taken = collections.Counter(), collections.Counter()
    for r in out:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert r.taken in (0, r["size"], 2 * r["size"])
    want = brute_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 40 for s in sizes) and sum(taken.values()) <= 1.5 * sum(sizes.values())
    again = fair_mix.fair_mix(df.coalesce(2)).collect()
    assert collections.Counter((r.doc_id, r.taken) for r in out) == collections.Counter((r.doc_id, r.taken) for r in again)


def test_mix_order_of_service(spark):
    """Against all services sorted by their virtual finish times on one machine."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(n)), "en", s, None) for i, (n, s) in enumerate(zip(rng.integers(1, 30, 800), rng.choice(["a", "b", "c"], 800, p=[0.5, 0.3, 0.2]).tolist()))]
    df = spark.createDataFrame(rows, DOCS)
    out = fair_mix.fair_mix(df).withColumn("h", fair_mix.shuffle_key(17, F.col("doc_id"), F.col("text"), F.col("source"))).collect()
    weight, services, budget = {"a": 3.0, "b": 1.0, "c": 2.0}, [], 1.5 * sum(r["size"] for r in out)
    for s in weight:
        at, mine = 0, sorted((r for r in out if r.source == s), key=lambda r: r.h)
        for _ in range(2):
            for r in mine:
                at += r["size"]
                services.append((at / weight[s], r.doc_id, r["size"]))
    taken, total = collections.Counter(), 0
    for _, d, n in sorted(services):
        total += n
        if total > budget:
            break
        taken[d] += n
    differ = [r.doc_id for r in out if r.taken != taken[r.doc_id]]
    assert len(differ) <= 1  # at the very end equal times may stand in another order


def test_mix_awkward(awkward):
    assert fair_mix.fair_mix(awkward).count() == awkward.count()
    assert fair_mix.fair_mix(awkward.limit(0)).count() == 0
    wordless = awkward.where("text is null or trim(text) = ''")
    assert all(r.taken == 0 for r in fair_mix.fair_mix(wordless).collect())


# 7


def brute_counts(t):
    t = t or ""
    w = words(t)
    times, cover = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
    for i in range(len(w) - 4):
        if times[tuple(w[i : i + 5])] > 1:
            cover |= set(range(i, i + 5))
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_base_counts(spark, small):
    texts = [r.text for r in small.limit(120).collect()] + AWKWARD + ["a b c d e f a b c d e g", "x\nx\n\n \nx", "p q r s t p q r s t p", "# * | < > $"]
    out = robust_outliers.base_counts(docs_of(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(out, texts):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(t), t


def brute_mcd(x, starts=40, share=robust_outliers.CORE):
    """Mean and consistent covariance of the least determinant over random starts, by exact concentration steps."""
    rng, p, best = np.random.default_rng(2), x.shape[1], None
    regular = lambda c: c + np.eye(p) * (1 / 12 + 1e-6 * np.trace(c))
    for k in range(starts):
        m, c = (x.mean(0), np.cov(x.T, bias=True)) if k == 0 or len(x) <= p + 1 else (lambda y: (y.mean(0), np.cov(y.T, bias=True)))(x[rng.choice(len(x), p + 1, replace=False)])
        for _ in range(15):
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(regular(c)), x - m)
            y = x[np.argsort(d, kind="stable")[: int(np.ceil(share * len(x)))]]
            m, c = y.mean(0), np.cov(y.T, bias=True).reshape(p, p)
        det = np.linalg.slogdet(regular(c))[1]
        best = (det, m, regular(c)) if best is None or det < best[0] else best
    return best[1], best[2] * robust_outliers.consistency(share, p), best[0]


def test_rules_keep_clean_and_reject_junk(spark):
    """On labels, and against brute force over each language and source."""
    base = "/root/testdata/sf0.01"
    out = queries.QUERIES["op7_quality_rules"](spark, base)
    groups = {r.doc_id: (r.lang, r.source) for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    stats = out.withColumns(robust_outliers.statistics()).orderBy("doc_id").collect()
    out = {r.doc_id: r for r in stats}
    good, bad = [], []
    for r in spark.read.parquet(f"{base}/labels.parquet").collect():
        o = out[r.doc_id]
        assert o.base_failed == (o.n_words < 10 or 100 * o.n_repeat_words > 20 * o.n_words)
        (good if r.quality == 1 else bad).extend([o.kept] * (not o.base_failed))
    assert not any(bad) and sum(good) >= 0.98 * len(good)
    rows = [r for r in stats if not r.base_failed]
    x = np.array([[r[c] for c in robust_outliers.STATS] for r in rows], float)
    lang, own = np.array([groups[r.doc_id][0] for r in rows]), np.array(["/".join(groups[r.doc_id]) for r in rows])
    drawn = lambda mine, n, wide, k: tuple((n * a + k * b) / (n + k) for a, b in zip(mine, wide))
    m, c, _ = brute_mcd(x)
    top = drawn((m, c), len(x), (m, np.eye(5) * robust_outliers.WIDE**2), robust_outliers.DRAW_ALL)
    kept = np.zeros(len(x), bool)
    cutoff = robust_outliers.chi2_quantile(1 - robust_outliers.LEVEL, 5)
    for a in set(lang):
        wide = drawn(brute_mcd(x[lang == a])[:2], (lang == a).sum(), top, robust_outliers.DRAW)
        for b in set(own[lang == a]):
            y = x[own == b]
            m, c = drawn(brute_mcd(y, 10)[:2], len(y), wide, robust_outliers.DRAW)
            kept[own == b] = np.einsum("ij,jk,ik->i", y - m, np.linalg.inv(c), y - m) <= cutoff
    assert (kept == np.array([r.kept for r in rows])).mean() >= 0.985
    # no ball about the middle of all rejects the same
    far = ((x - np.median(x, 0)) ** 2).sum(1)
    assert not np.array_equal(far <= np.sort(far)[kept.sum() - 1], kept)


def test_concentration_finds_the_least_determinant(spark):
    rng = np.random.default_rng(9)
    core = rng.multivariate_normal([0, 0, 0, 0, 0], np.diag([4e4, 1e4, 900, 2e5, 4e4]) + 500, 700)
    x = np.round(np.concatenate([core, rng.normal(5000, 50, (150, 5))]))
    rows = [("g", *map(int, y)) for y in x] + [("one", 1, 2, 3, 4, 5)] + [("same", 7, 7, 7, 7, 7)] * 9
    found = {r.g: r for r in robust_outliers.fit_mcd(spark.createDataFrame(rows, "g string, x0 long, x1 long, x2 long, x3 long, x4 long"), True).collect()}
    m, c, det = brute_mcd(x)
    r = found["g"]
    mine = np.array([[r[f"c{max(i, j)}{min(i, j)}"] for j in range(5)] for i in range(5)])
    assert r.n == 850 and np.linalg.slogdet(mine / robust_outliers.consistency(0.75, 5))[1] <= det + 0.2
    assert np.abs(np.array([r[f"m{i}"] for i in range(5)]) - m).max() < 40 and np.abs(np.diag(mine) / np.diag(c) - 1).max() < 0.1
    assert (found["one"].m4, found["same"].m0) == (5, 7) and found["same"].c00 > 0


def test_chi_square():
    for share, p, want in ((0.999, 5, 20.515), (0.75, 5, 6.6257), (0.5, 2, 1.38629), (0.95, 1, 3.8415)):
        assert abs(robust_outliers.chi2_quantile(share, p) - want) < 1e-3


def test_rules_awkward(awkward):
    assert robust_outliers.quality_rules(awkward).count() == awkward.count()
    junk = robust_outliers.quality_rules(awkward.where("text is null or length(text) < 5"))
    assert junk.count() == 5 and not junk.where("kept or distance2 is not null").count()
    assert robust_outliers.quality_rules(awkward.limit(0)).count() == 0


# 8


def test_neighbours(spark):
    rng = np.random.default_rng(10)
    v = rng.normal(size=(900, 8)).astype(np.float32)
    v[100:400] = v[100]
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)]
    odd = [(1000, None), (1050, [0.0] * 8), (1100, [float("nan")] * 8), (1150, [1.0, None] + [0.0] * 6), (1200, [float("inf")] + [0.0] * 7), (1250, [1.0]), (None, [1.0] * 8), (5, rows[5][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(4)
    index = vp_tree.build_index(df, 200)
    got = collections.defaultdict(list)
    for r in vp_tree.search(index, df.where("vec_id % 50 = 0"), 5, 1.0, block=7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    u = v.astype(float)
    assert set(got) == set(range(0, 900, 50))
    for q in got:
        score = vp_tree.cosines(u[q], u)
        score[q] = -9
        best = np.lexsort((np.arange(900), -score))[:5]
        assert [i for i, _ in got[q]] == best.tolist() and np.allclose([s for _, s in got[q]], score[best], atol=1e-15)
    for factor, least in ((0.5, 1.0), (1.5, 0.95), (2.0, 0.9)):
        loose = vp_tree.search(index, df.where("vec_id % 50 = 0"), 5, factor).collect()
        near = sum((r.vec_id, r.score) in got[r.query_id] for r in loose)
        assert near >= least * sum(map(len, got.values())), factor
    clash = df.withColumns({c: F.lit("clash") for c in ("pivot", "part", "limit", "parts", "block")})
    assert vp_tree.search(vp_tree.build_index(clash, 200), clash.where("vec_id % 50 = 0")).collect() == vp_tree.search(index, df.where("vec_id % 50 = 0")).collect()
    assert vp_tree.search(vp_tree.build_index(df.limit(0)), df.limit(0)).count() == 0
    few = df.where("vec_id in (50, 51)")
    assert vp_tree.search(vp_tree.build_index(few), few).count() == 2


# 9


def test_tokens_equal_the_tokenizers(small):
    from tokenizers import Tokenizer

    path = harmonic_pack.default_tokenizer()
    whole, fast = Tokenizer.from_file(path), fast_tokens.WordTokens(path)
    texts = [r.text for r in small.collect()] + [t or "" for t in AWKWARD]
    texts += ["it's we've 'tis don't!! can't's", "İstanbul ΣΑΣ ﬁn é Å", "a<|endoftext|>b <|startoftext|> <|x", "3.14 x2y _under_ --", "日本語 テキスト", "".join(map(chr, range(1, 0x500)))]
    column = pa.chunked_array([texts[:7], texts[7:]]).combine_chunks()
    for a, n in ((0, len(texts)), (5, 20), (len(texts) - 8, 8)):
        ids, bounds = fast.encode(column.slice(a, n))
        for k, t in enumerate(texts[a : a + n]):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids, t


def check_packing(out, texts, capacity):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(harmonic_pack.default_tokenizer())
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d, t in texts.items():
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    pad = total = 0
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        total += at
        pad += 0 if at & (at - 1) == 0 else capacity - at
    return pad / total


def test_packing(spark, small):
    texts = {r.doc_id: r.text for r in small.collect()}
    assert check_packing(harmonic_pack.pack(small.repartition(3), harmonic_pack.default_tokenizer()).collect(), texts, 4096) < 0.01
    odd = docs_of(spark, AWKWARD)
    assert check_packing(harmonic_pack.pack(odd, harmonic_pack.default_tokenizer(), 64).collect(), dict(enumerate(AWKWARD)), 64) < 0.2


def test_packing_keeps_documents_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = harmonic_pack.pack(docs.coalesce(1), harmonic_pack.default_tokenizer()).collect()
    pieces = collections.Counter(r.doc_id for r in out)
    fit = {r.doc_id for r in out if r.doc_tokens <= 4096}
    assert sum(pieces[d] == 1 for d in fit) >= 0.9 * len(fit)
    # bins of whole documents hold as many as their class says
    held = collections.defaultdict(list)
    for r in out:
        held[r.sequence_id].append(r)
    full = [rows for rows in held.values() if sum(r.length for r in rows) == 4096]
    assert sum(sum(r.length for r in rows) for rows in full) >= 0.95 * sum(r.length for r in out)


@pytest.mark.parametrize("capacity", [1, 8, 64])
def test_packer_on_random_sizes(capacity):
    rng = np.random.default_rng(capacity)
    packer, out, n = harmonic_pack._Packer(3, capacity), [], 0
    sizes = [rng.integers(1, hi, int(k)) for hi, k in ((2, 30), (200, 50), (capacity + 1, 400), (9, 0), (capacity + 1, 1))]
    for s in sizes:
        ids = rng.integers(0, 9, int(s.sum())).astype(np.uint32)
        out.append(packer.add(np.arange(n, n + len(s)), s, ids))
        n += len(s)
    out = harmonic_pack._joined([*out, packer.finish()])
    flat, seen, used = np.concatenate(sizes), collections.defaultdict(list), collections.defaultdict(list)
    for row, start, length, seq, off in zip(*(out[k].tolist() for k in ("row", "start", "length", "sequence", "offset"))):
        seen[row].append((start, length))
        used[seq].append((off, length))
    for d, parts in seen.items():
        assert [a for a, _ in sorted(parts)] == [0, *itertools.accumulate(x for _, x in sorted(parts))][:-1] and sum(x for _, x in parts) == flat[d]
    assert len(seen) == n
    for parts in used.values():
        assert [a for a, _ in sorted(parts)] == [0, *itertools.accumulate(x for _, x in sorted(parts))][:-1] and sum(x for _, x in parts) <= capacity


def test_packing_awkward(awkward):
    path = harmonic_pack.default_tokenizer()
    out = harmonic_pack.pack(awkward, path).collect()
    assert sum(r.length for r in out if r.doc_id is None) == 5 and harmonic_pack.pack(awkward.limit(0), path).count() == 0


# 10


def brute_components(texts):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4)))

    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("run_nodes", [4096, 10])
def test_join_against_brute_force(spark, monkeypatch, run_nodes):
    monkeypatch.setattr(jaccard_join, "RUN_NODES", run_nodes)
    rng = np.random.default_rng(12)
    vocabulary = [f"w{i}" for i in range(4000)]
    fresh = lambda n: [vocabulary[i] for i in rng.integers(0, 4000, n)]
    common, texts = fresh(40), []
    for g in range(12):
        base = fresh(int(rng.integers(6, 160)))
        for _ in range(int(rng.integers(1, 14))):
            w = list(base)
            for _ in range(int(rng.integers(0, 1 + len(w) // 14))):
                w[int(rng.integers(len(w)))] = vocabulary[int(rng.integers(4000))]
            texts.append(" ".join(w))
    texts += [" ".join(fresh(50) + common + fresh(int(rng.integers(0, 60)))) for _ in range(30)] + [" ".join(common)] * 5
    texts += [None, "", "a b", "A  b\n", "a b c", "one two three four five", "ONE two three four five", "ÉÉ b c d e", "éé b c d e"]
    want = brute_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs_of(spark, texts).repartition(6)).collect()}
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("block, held", [(1_000_000, 2_000_000), (4_000, 500)])
def test_join_of_near_copies_without_a_row_per_pair(spark, monkeypatch, block, held):
    monkeypatch.setattr(jaccard_join, "CROWD_TOKENS", block, raising=False)
    monkeypatch.setattr(jaccard_join, "HELD_PAIRS", held, raising=False)
    rng = np.random.default_rng(5)
    base, texts = [f"w{i}" for i in range(150)], []
    for n in range(240):
        w = list(base)
        for _ in range(int(rng.integers(2, 6))):
            w[int(rng.integers(len(w)))] = f"x{n}"
        texts.append(" ".join(w))
    rows, dealt = [], jaccard_join._in_groups
    monkeypatch.setattr(jaccard_join, "_in_groups", lambda pairs, n: dealt(pairs, rows.append(n) or n))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs_of(spark, texts).repartition(6)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)
    # the first are the chained pairs; the nodes of the others may be in several groups
    assert len(rows) and sum(rows[1:]) <= 8 * len(texts)


def test_join_awkward(spark, awkward):
    out = jaccard_join.jaccard_components(awkward)
    assert out.count() == awkward.count()
    assert {r.component_id for r in out.where("doc_id in (7, 8)").collect()} == {7}
    assert jaccard_join.jaccard_components(awkward.limit(0)).count() == 0
    assert jaccard_join.jaccard_components(docs_of(spark, [None, ""])).count() == 2


def test_hashes_of_words():
    texts = ["The the\x0bTHE", None, "", "a  b", "ÄB äb"] + ["x" * 9000]
    h, b = hashed.word_hashes(pa.array(texts))
    assert np.diff(b).tolist() == [3, 0, 0, 2, 2, 1] and len({*h[:3].tolist()}) == 1 and h[5] != h[6]


# pipeline


def test_pipeline_stages(spark, small):
    docs = small
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != names[-1]:
            assert out.columns == small.columns
            rows = out.collect()
            assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
        if name == "n-gram Jaccard join":
            texts = [r.text for r in docs.orderBy("doc_id").collect()]
            ids = [r.doc_id for r in docs.orderBy("doc_id").collect()]
            assert sorted(r.doc_id for r in rows) == sorted({ids[c] for _, c in brute_components(texts)})
        if name == "packing":
            # documents come repeated here, so pieces are told by their number
            total = out.agg(F.sum("length")).first()[0]
            assert total == sum(r.doc_tokens for r in out.where("start = 0").collect())
        docs = spark.createDataFrame(rows, small.schema) if name != names[-1] else out


def test_one_row_of_each_component_stays(spark, awkward):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(5, base, "en", "a", 1), (3, base + " more", "en", "a", 1), (3, "something else of seven words in all", "en", "a", 1), (3, base + " more", "en", "b", 2), (None, base, None, None, None), (None, "alone " * 9, None, None, None), (9, None, None, None, None), (9, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"_hash": F.lit("clash"), "node": F.lit("clash")})
    out = jaccard_join.one_per_component(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:5]) for r in out.collect()) == [(False, 3, "somet"), (False, 3, "w0 w1"), (False, 9, ""), (False, 9, ""), (True, 0, "alone")]
    assert jaccard_join.one_per_component(awkward.limit(0)).count() == 0


def test_resampling_takes_texts_apart_in_small_blocks():
    """A worker counts a batch of 4 MB of text in less than 25 MB besides."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from gridloom.llm import importance_resample

    words = np.random.default_rng(0).integers(0, 5000, (2000, 400))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(2000), pa.int64()), "text": [" ".join(map(str, w)) for w in words]})
    tracemalloc.start()
    list(importance_resample._count(SimpleNamespace(value=np.arange(3)))(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6
