"""The ten operators and the pipeline: edge cases, and results against brute force or the libraries."""

import base64
import hashlib
import io
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from twinframe.llm import extract, minhash, packing, quality, queries, sharding, tokens, toxicity, vectors, warc
from twinframe.llm.byte_bpe import codec, decode_ids, encode_texts, round_trip

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, score string, cid int, component string"
WORDS = [a + b for a in ("ba", "ko", "ti", "re", "su", "lo", "ne") for b in ("n", "ra", "mi", "to", "s", "ve")]


def odd_docs(spark, rows=None):
    """Nulls, empty and long texts, ties, repeated rows, and more columns whose names clash with the operators' own."""
    rows = rows if rows is not None else [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "a b c d e f g h i j k l"), (5, "a b c d e f g h i j k l"), (6, "A b c d e f g h i j k l"), (None, "null id here and more words to count on"), (7, "lang wort " * 30_000), (8, "日本語 テスト 😀 \x00 é x" * 3)]
    return spark.createDataFrame([(i, t, None if i == 4 else "en", "s" if i != 5 else None, 0, "x", "x", 1, "x") for i, t in rows], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def test_empty_tables(spark):
    docs = odd_docs(spark, []).where("false")
    assert packing.pack(docs, P.path("word_bpe_49k.json")).count() == 0
    assert quality.quality_rules(docs).count() == 0
    assert tokens.token_counts(docs, P.path("piece_bpe_32k.model")).count() == 0
    assert sharding.assign_shards(docs, 100).count() == 0
    assert round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert minhash.near_duplicates(docs).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.toxicity(docs, labels).count() == 0
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.archive_round_trip(pages).count() == 0 and extract.extract_pages(pages).count() == 0
    for kept in (toxicity.drop_toxic(docs, labels), quality.keep_quality(docs), minhash.drop_near_duplicates(docs)):
        assert kept.columns == docs.columns and kept.count() == 0


def test_stages_of_odd_documents(spark):
    """Every stage returns the columns and whole rows of its input, of documents with nulls, no words, repeated ids and clashing names."""
    docs = odd_docs(spark)
    rows = Counter(map(tuple, docs.collect()))
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1)], "doc_id bigint, toxic int")
    for kept in (toxicity.drop_toxic(docs, labels), quality.keep_quality(docs), minhash.drop_near_duplicates(docs)):
        got = Counter(map(tuple, kept.collect()))
        assert kept.columns == docs.columns and got and not got - rows
    assert Counter(r["doc_id"] for r in quality.keep_quality(docs).collect()) == {5: 2, 6: 1}
    assert 6 not in {r["doc_id"] for r in minhash.drop_near_duplicates(docs, 3, 85).collect()}
    wrong = [n for n in (None, 1) if sum(r["doc_id"] == n for r in minhash.drop_near_duplicates(docs).collect()) != 1]
    assert not wrong


def test_pipeline_of_empty_tables(spark, tmp_path):
    odd_docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    docs = odd_docs(spark)
    rows = packing.pack(docs, P.path("word_bpe_49k.json"), per_block=4).collect()
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for r in docs.collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want += [(r["doc_id"], i // 2048, i, len(ids[i : i + 2048]), zlib.crc32(np.array(ids[i : i + 2048], "<u4").tobytes())) for i in range(0, len(ids), 2048)]
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == Counter(want)
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_genetic_search_never_worsens():
    rng = random.Random(3)
    lengths = [rng.choice([rng.randint(600, 1100), rng.randint(1, 300)]) for _ in range(300)]
    first = packing.evolve([], lengths, 2048, 1, 0)
    last = packing.evolve([list(b) for b in first], lengths, 2048, 1, 20)
    assert packing.fewest(lengths, 2048) <= len(last[0]) <= len(first[0])
    child, loads = packing.crossover(first[-1], first[0], lengths, 2048, rng)
    assert loads == [sum(lengths[i] for i in b) for b in child]
    assert sorted(i for b in child for i in b) == list(range(300)) and all(sum(lengths[i] for i in b) <= 2048 for b in child)


def test_packing_refuses_tokenizers_that_see_across_blanks(tmp_path):
    import json

    spec = json.load(open(P.path("word_bpe_49k.json"), encoding="utf-8"))
    for change in ({"truncation": {"direction": "Right", "max_length": 5, "strategy": "LongestFirst", "stride": 0}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}):
        with open(tmp_path / "t.json", "w", encoding="utf-8") as f:
            json.dump(spec | change, f)
        with pytest.raises(ValueError, match="the tokenizer"):
            packing.WordEncoder(f"{tmp_path}/t.json")


def triples(n, rng):
    """Lengths that n bins of 2048 can hold without a gap, three to each."""
    lengths = []
    for _ in range(n):
        a = rng.randint(500, 900)
        b = rng.randint(500, min(900, 1848 - a))
        lengths += [a, b, 2048 - a - b]
    rng.shuffle(lengths)
    return lengths


def test_genetic_search_gains_on_exact_triples():
    for seed in range(3):
        lengths = triples(100, random.Random(seed))
        best_fit = packing.evolve([], lengths, 2048, 1, 0)[0]
        found = packing.evolve([], lengths, 2048, 1, 100)[0]
        assert len(best_fit) >= 106 and len(found) <= 102
        assert sorted(i for b in found for i in b) == list(range(300)) and all(sum(lengths[i] for i in b) <= 2048 for b in found)


def test_packing_of_exact_triples(spark):
    rows = [(i, n) for i, n in enumerate(triples(60, random.Random(9)))]
    placed = packing._pack_blocks(spark.createDataFrame(rows, "uid bigint, length bigint"), 2048, 4096, 2, 3, 60, 0).collect()
    assert sorted((r["uid"], r["length"]) for r in placed) == rows and len({r["bin"] for r in placed}) <= 62


def test_fewest_bins_is_a_bound():
    def optimum(lengths, size):
        best = len(lengths)

        def put(i, loads):
            nonlocal best
            if len(loads) >= best:
                return
            if i == len(lengths):
                best = len(loads)
                return
            for b in range(len(loads)):
                if loads[b] + lengths[i] <= size:
                    put(i + 1, [*loads[:b], loads[b] + lengths[i], *loads[b + 1 :]])
            put(i + 1, [*loads, lengths[i]])

        put(0, [])
        return best

    rng = random.Random(5)
    for _ in range(60):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 7))]
        assert max(-(-sum(lengths) // 20), sum(2 * x > 20 for x in lengths)) <= packing.fewest(lengths, 20) <= optimum(lengths, 20)
    assert packing.fewest([11, 11, 10], 20) == 3 and packing.fewest([7, 7, 7, 7], 20) == 2


def brute_counts(text):
    words = "".join(c if c not in " \t\n\v\f\r" else " " for c in text).split(" ")
    words = [w for w in words if w]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if line.strip(" \t\n\v\f\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside)


def test_quality_counts(spark):
    docs = odd_docs(spark)
    got = Counter(tuple(r)[:6] for r in quality.quality_rules(docs).collect())
    assert got == Counter((r["doc_id"], *brute_counts(r["text"] or "")) for r in docs.collect())
    words = [str(i % 77) if i % 3 else "z" for i in range(120_000)]
    assert quality.repeated_words([w.encode() for w in words]) == len(words)


def test_quality_thresholds(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        text = prose(rng, rng.randint(30, 80))
        rows.append((i, text if i % 7 else " ".join(w + "$$$" for w in text.split()), "en" if i % 2 else None, f"s{i % 3}" if i < 390 else "rare", 0, "", "", 0, ""))
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs).collect()}
    assert got == {i: bool(i % 7) for i in range(400)}
    kept = quality.keep_quality(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i]}
    floor = lambda v: v >> max(v.bit_length() - 7, 0) << max(v.bit_length() - 7, 0)
    values = [0, 1, 127, 128, 129, 1000, 123456]
    df = spark.createDataFrame([(v,) for v in values], "value bigint")
    assert [r[0] for r in df.select(quality.bucket("value")).collect()] == [floor(v) for v in values]


def test_quality_limits_against_exact_quantiles(spark):
    """The limits of every language and source, from sorted values instead of sketches."""
    rng = random.Random(8)
    rows = []
    for i in range(900):
        lang, source = rng.choice(["en", "de", None]), f"s{rng.choice([0, 0, 0, 1, 1, 2])}"
        words = prose(rng, rng.randint(10, 120)).split()
        marks = rng.choice([0, 0, 1, 4]) if source == "s1" else rng.choice([0, 0, 0, 1])
        rows.append((i, " ".join(w + rng.choice(["#", "!", "|"]) * (rng.random() < 0.05 * marks) + "\n" * (rng.random() < 0.1) for w in words), lang, source, 0, "", "", 0, ""))
    docs = spark.createDataFrame(rows, DOCS)
    counts = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    values = defaultdict(list)
    for i, _, lang, source, *_ in rows:
        r = counts[i]
        if not r["base_failed"]:
            for m, (c, k) in quality.METRICS.items():
                values[lang, source, m].append(k * r[c] // r["n_words"])
            values[lang, source, "words"].append(r["n_words"])
    floor = lambda v: v >> max(v.bit_length() - 7, 0) << max(v.bit_length() - 7, 0)
    exact = lambda x: [floor(sorted(x)[max(0, -(-p * len(x) // 100) - 1)]) for p in quality.QUANTILES]
    mix = lambda own, n, wide: [(n**3 * a + quality.SHRINK**3 * b) // (n**3 + quality.SHRINK**3) for a, b in zip(own, wide, strict=True)]
    limits = {(r["lang"], r["source"]): r for r in quality.thresholds(spark.createDataFrame([(r["doc_id"], *(r[c] for c in quality.COUNTS), rows[i][2], rows[i][3]) for i, r in counts.items()], "doc_id bigint, " + ", ".join(f"{c} bigint" for c in quality.COUNTS) + ", lang string, source string")).collect()}
    assert len(limits) == len({k[:2] for k in values}) == 9
    for (lang, source), got in limits.items():
        q = {}
        for m in (*quality.METRICS, "words"):
            of_lang = [v for k, x in values.items() if k[0] == lang and k[2] == m for v in x]
            of_all = [v for k, x in values.items() if k[2] == m for v in x]
            wide = exact(of_lang) if m in ("length", "words") else mix(exact(of_lang), len(of_lang), exact(of_all))
            q[m] = mix(exact(values[lang, source, m]), len(values[lang, source, m]), wide)
        one = lambda m: 8 * (q["length"][2] if m == "length" else 1000) // q["words"][0]  # noqa: E731, B023
        for m in quality.METRICS:
            assert got[f"{m}_max"] == q[m][3] + q[m][3] // 64 + 8 * (q[m][3] - q[m][2]) + one(m)
        assert got["length_min"] == q["length"][1] - 8 * (q["length"][2] - q["length"][1]) - one("length")
    assert len({got["symbols_max"] for got in limits.values()}) > 4


def test_quality_limits_follow_the_groups(spark):
    """The same texts are junk where no others have symbols, and as good as any where all have some."""
    rng = random.Random(4)
    marked = lambda n: " ".join(w + "#" * (j < n) for j, w in enumerate(prose(rng, 80).split()))
    rows = [(i, marked(0), "en", "plain") for i in range(100)] + [(100 + i, marked(i % 25), "en", "marked") for i in range(100)]
    rows += [(200 + i, marked(11), "en", "plain" if i < 5 else "marked") for i in range(10)] + [(300, marked(2), "en", "plain"), (301, marked(80).replace("#", "###"), "en", "marked")]
    docs = spark.createDataFrame([(*r, 0, "", "", 0, "") for r in rows], DOCS)
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs).collect()}
    assert {i for i in got if not got[i]} == {200, 201, 202, 203, 204, 301}


def test_token_counts(spark):
    from sentencepiece import SentencePieceProcessor

    docs = odd_docs(spark)
    sp = SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = tokens.token_counts(docs, P.path("piece_bpe_32k.model")).collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()), len(sp.encode(r["text"] or ""))) for r in docs.collect()]
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == Counter(want)
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)


def test_byte_bpe(spark):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = odd_docs(spark)
    want = []
    for r in docs.collect():
        ids = enc.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert Counter(map(tuple, round_trip(docs, path, P.PATTERN).collect())) == Counter(want)
    back = decode_ids(encode_texts(docs.where("doc_id = 8"), path, P.PATTERN), path, P.PATTERN).first()["decoded"]
    assert bytes(back).decode() == docs.where("doc_id = 8").first()["text"]
    assert all(codec(path, P.PATTERN).words[t.decode()] == r.to_bytes(4, "little") for t, r in list(ranks.items())[1000:1200] if t.isalpha() and t.isascii())


VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute_links(x, least=0.95):
    """Number of links and component of each row, over all pairs."""
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = u @ u.T >= least
    comp = np.arange(len(x))
    while True:
        new = np.where(linked, comp[None], len(x)).min(axis=1)
        if (new == comp).all():
            return linked.sum(1) - 1, comp
        comp = new


@pytest.mark.parametrize("size", [4, 8, 16, 64])
def test_vectors_against_brute_force(spark, monkeypatch, size):
    """Every link and component, where one in two vectors has a neighbour near the limit; with small blocks, so that groups are divided."""
    monkeypatch.setattr(vectors, "BLOCK", 150)
    monkeypatch.setattr(vectors, "QUERIES", 200)
    monkeypatch.setattr(vectors, "LIST_ROWS", 30)
    rng = np.random.default_rng(size)
    base = rng.normal(size=(400, size))
    near = base + rng.normal(size=base.shape) * rng.random((400, 1)) * 0.5
    x = np.vstack([base, near, base[:10] * 2, base[:5]]).astype(np.float32)
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS)).collect()}
    links, comp = brute_links(x)
    assert links.sum() > 300 and len(got) == len(x)
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (links[i], comp[i], comp[i] == i) for i in range(len(x)))


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [2.0, 0.0], 0), (3, [2.0, 0.0], 0), (4, [1e30, 1e30, 0.0, 0.0], 0), (5, [1e-30, 1e-30, 0.0, 0.0], 0), (6, [1.0, 0.0, 0.0, 0.0], 0), (7, [0.0, 0.0, 1.0, 0.0], 0), (8, [3.0], 0), (9, [1.0, 0.0, 0.0, 0.0, 0.0], 0)]
    none = [(1000, None, 0), (1001, [0.0] * 4, 0), (1002, [float("nan")] * 4, 0), (1003, [None, 1.0], 0), (1004, [float("inf"), 1.0], 0), (1005, [], 0), (None, [1.0, 0.0], 0)]
    got = Counter(tuple(r) for r in vectors.near_vectors(spark.createDataFrame(rows + none, VECTORS)).collect())
    linked = {(1, 3, 1, True): 1, (2, 3, 1, False): 1, (3, 3, 1, False): 2, (4, 1, 4, True): 1, (5, 1, 4, False): 1}
    assert got == Counter(linked | {(i, 0, i, True): 1 for i in (6, 7, 8, 9, 1000, 1001, 1002, 1003, 1004, 1005, None)})


def test_warc_round_trip(spark):
    pages = [(1, "http://a", "<p>x</p>"), (2, "http://b\r\nWARC-Type: x", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", "é" * 100_000), (None, "n", "<p>x</p>"), (2, "http://b\r\nWARC-Type: x", "<p>x</p>")]
    got = warc.archive_round_trip(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()
    digest = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    refers = {1: 2, 3: 4}
    want = [(i, len((h or "").encode()), digest(h), "revisit" if i in refers else "response", refers.get(i), u) for i, u, h in pages]
    assert Counter(map(tuple, got)) == Counter(want)


def test_warc_reader_refuses_damage():
    good = warc.record(1, "u", b"payload", None)
    assert warc.parse(good).payload == b"payload"
    with pytest.raises(ValueError, match="digest"):
        warc.parse(good.replace(b"payload", b"pAyload"))
    with pytest.raises(ValueError, match="framed"):
        warc.parse(good[:-1])
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.members(io.BytesIO(warc.gzip_member(good)[:-4])))
    assert list(warc.members(io.BytesIO(warc.gzip_member(b"a") + warc.gzip_member(b"b")), 3)) == [b"a", b"b"]


def test_warc_revisits_are_verified(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", 2), (2, "u", "<p>x</p>", None)], "page_id bigint, url string, html string, refers_to bigint")
    good = warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/a"))
    assert warc.verified(good).count() == 2
    tampered = warc.record(1, "u", b"<p>y</p>", 2)
    assert warc.parse(tampered).kind == "revisit"  # alone, it looks right
    with open(f"{tmp_path}/t.warc.gz", "wb") as f:
        f.write(warc.gzip_member(tampered) + warc.gzip_member(warc.record(2, "u", b"<p>x</p>", None)))
    bad = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/t.warc.gz", 2)], "archive string, n_records bigint"))
    with pytest.raises(Exception, match="the revisit 1 isn't"):
        warc.verified(bad).collect()


@pytest.mark.parametrize("most", [0, 200_000])
def test_warc_by_both_joins_and_of_bytes_that_are_no_text(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "MOST_BROADCAST", most)
    rows = spark.createDataFrame([(1, b"u\xff", b"\xff\xfe"), (2, b"u", b"\xff\xfe"), (3, b"u", b"ok")], "page_id bigint, url binary, html binary")
    got = {r["page_id"]: r for r in warc.archive_round_trip(rows.selectExpr("page_id", "cast(url as string) url", "cast(html as string) html")).collect()}
    digest = base64.b32encode(hashlib.sha1(b"\xff\xfe").digest()).decode()
    assert [(got[i]["payload_digest"] == digest, got[i]["payload_bytes"], got[i]["refers_to"]) for i in (1, 2, 3)] == [(True, 2, 2), (True, 2, None), (False, 2, None)]
    assert got[1]["url"] == "u\ufffd"


def test_written_shards(spark, tmp_path):
    docs = odd_docs(spark, [(1, "x" * 30)] * 3 + [(1, "y" * 300), (2, "z"), (None, None)]).withColumn("shard", F.lit("own"))
    for limit, name in ((64, "many"), (10_000, "one")):
        names = sharding.write_shards(docs, limit, f"{tmp_path}/{name}")
        back = spark.read.parquet(f"{tmp_path}/{name}")
        assert names == ("_shard", "page") and set(back.columns) == {*docs.columns, *names} and back.where("_shard is null").count() == 0
        assert Counter(map(tuple, back.select(docs.columns).collect())) == Counter(map(tuple, docs.collect()))
        sizes = back.groupBy(*names).agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()
        assert all(r["n"] == 1 or r["b"] <= limit for r in sizes)


def test_written_shards_beside_columns_of_another_case(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * i, "a", i) for i in range(20)], "doc_id bigint, text string, Shard string, PAGE int")
    assert sharding.write_shards(docs, 60, f"{tmp_path}/out") == ("_shard", "_page")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 20 and {"Shard", "PAGE", "_shard", "_page"} <= set(back.columns)


def test_shards(spark):
    rows = [(i, "x" * (i % 50)) for i in range(500)] + [(9999, "y" * 5000)] + [(7777, "z" * 30)] * 40 + [(None, None)]
    got = sharding.assign_shards(odd_docs(spark, rows), 400).collect()
    assert len(got) == len(rows) and sum(r["n_bytes"] for r in got) == sum(len(t or "") for _, t in rows)
    total, n = Counter(), Counter()
    for r in got:
        total[r["shard"], r["page"]] += r["n_bytes"]
        n[r["shard"], r["page"]] += 1
        assert len(r["shard"]) == r["depth"]
    assert all(b <= 400 or n[k] == 1 for k, b in total.items())
    names = {r["shard"] for r in got}
    assert not any(a != b and b.startswith(a) for a in names for b in names)


def test_extraction(spark):
    page = '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li>Menu</ul></nav><div class="cookie-notice">We use</div><!-- c --><article><h1>Head &amp; more</h1><p>First  <b>long</b>\n paragraph that goes on and on and on for a good while, to be of some length.<br>next<p>Short.</p><form>mail</form><section id="comments"><p>Nice!</p></section></article><aside>side</aside><footer>&copy;</footer></body></html>'
    bare = "<div id=sidebar>Links</div><div><p>" + "word " * 40 + "</p><p>end.</p></div><div class='ad'>Buy</div>"
    rows = [(1, "u", page, 0), (2, None, bare, 0), (3, "u", None, 0), (4, "u", "", 0), (None, "u", "plain", 0), (1, "u", page, 0)]
    got = extract.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")).collect()
    texts = defaultdict(list)
    for r in got:
        texts[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert texts[1] == ["Head & more First long paragraph that goes on and on and on for a good while, to be of some length. next Short."] * 2
    assert texts[2] == ["word " * 39 + "word end."] and texts[3] == texts[4] == [""] and texts[None] == ["plain"]


def test_extraction_ends_what_it_skips():
    body = "<article><p>" + "word " * 30 + "</p><p>End.</p></article>"
    want = "word " * 30 + "End."
    for page in (
        '<p class="notice">We <b>moved' + body,
        '<ul><li class="share">A<li>B</ul>' + body,
        '<div><p class="notice">We moved</div>' + body,
        '<table><tr><td class="ad">x<td>y<tr><td class=promo>z</table>' + body,
        '<dl><dt class="menu">a<dd class="menu">b</dl>' + body,
        "<head><meta charset=utf-8><body>" + body,
        '<div class="layout has-sidebar">' + body + '<div class="sidebar">Links</div></div>',
        '<form id="all">' + body + "</form>",
        '<span class="ad"><span>x</span>y</span>' + body,
    ):
        assert extract.main_text(page) == want, page
    assert extract.main_text('<div class="has-sidebar"><p>' + "word " * 30 + "</p><p>End.</p></div>") == want
    assert extract.main_text('<main><p>' + "word " * 30 + '</p><p>End.</p><div id="comments">' + "<article><p>nice " * 90 + "</div></main>") == want


def test_extraction_keeps_paragraphs_in_divs():
    long = "word " * 40
    page = f"<div><p>{long}</p></div><div><h2>Head</h2></div><div><p>No.</p></div><table><tr><td>a</td></tr><tr><td>b</td></tr></table><div><p>{long}</p></div><div><p>Short closing line.</p></div>"
    assert extract.main_text(page) == f"{long}Head No. a b {long}Short closing line."
    menu = "<div><ul>" + "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(9)) + "</ul></div>"
    assert extract.main_text(f"{menu}<div><p>{long}</p></div><div><p><a href=/>Source</a></p></div><nav>x</nav>{menu}") == f"{long}Source"
    assert extract.main_text(f"<h1><a href=/>Title</a></h1><div><p>{long}</p></div>{menu}<p>{long}</p>").startswith(f"Title {long}Item 0")


def test_extraction_keeps_what_only_looks_marked():
    long = "word " * 30
    for page in (
        f'<div class="content with-sidebar"><article><p>{long}</p><p>End.</p></article></div>',
        f'<article><div class="page-header"><h2>{long}</h2></div><p>End.</p></article>',
        f'<article><section class="social-history"><p>{long}</p></section><p>End.</p></article>',
        f"<p><a href=it's>word</a> {long[5:]}</p><p>End.</p>",
        f'<p data-id="ad">{long}</p><p title="a > b" class=x>End.</p>',
        f"<article><p>{long}</p><p class='ad-free'>End.</p><div class='top-ad-box'>Buy</div><div id=user_comments>Nice</div><div class='x siteHeader site-header'>Y</div></article>",
    ):
        assert extract.main_text(page) == long + "End.", page


def brute_between(lines, surge):
    """The same by its definition: sums of every three lines that stand together, each looked at by itself."""
    n = len(lines)
    first = lambda i: next(j + 1 for j in range(i, -2, -1) if j < 0 or not lines[j])
    last = lambda i: next(j for j in range(i, n + 1) if j == n or not lines[j])
    kept = set()
    for i in range(n):
        for width in (1, 2, 3):
            if i + width <= n and all(lines[i : i + width]) and sum(map(len, lines[i : i + width])) >= surge:
                kept |= set(range(first(i), last(i)))
    if not kept:
        spans = sorted({(first(i), last(i)) for i in range(n) if lines[i]}, key=lambda s: (-sum(map(len, lines[s[0] : s[1]])), s))
        kept = set(range(*spans[0])) if spans else set()
    return [lines[i] for i in sorted(kept)]


def test_line_blocks_against_brute_force():
    rng = random.Random(6)
    for _ in range(500):
        lines = [rng.choice(["", "", "x" * rng.randint(1, 50), "y" * rng.randint(1, 30), "z" * rng.randint(1, 90)]) for _ in range(rng.randint(0, 25))]
        assert extract.between_surge_and_dive([extract.Line(x, False, False) for x in lines]) == brute_between(lines, extract.SURGE)


def test_extraction_takes_articles_as_hints():
    long = "word " * 40
    cards = "<article><h3>Teaser</h3></article>" * 2
    assert extract.main_text(f"<div><p>{long}</p><p>End.</p></div>{cards}") == f"{long}End."
    assert extract.main_text(f"<div>{'other ' * 20}</div><article><p>{long}</p><aside>x</aside><p>End.</p></article>") == f"{long}End."


def toxic_docs(spark, n=600):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(n):
        toxic = i % 6 == 0
        words = prose(rng, rng.randint(30, 90)).split()
        if toxic:
            for _ in range(5):
                words.insert(rng.randrange(len(words)), "vile" + rng.choice(["x", "ing", "ous"]))
        rows.append((i, " ".join(words)))
        if rng.random() < 0.6:
            marks.append((i, int(toxic)))
    return odd_docs(spark, rows), spark.createDataFrame([*marks, (None, 1), (3, None)], "doc_id bigint, toxic int")


def test_toxicity(spark):
    docs, labels = toxic_docs(spark)
    got = toxicity.toxicity(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert np.mean([r["predicted"] == (r["doc_id"] % 6 == 0) for r in got]) > 0.97
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    none = toxicity.toxicity(odd_docs(spark), labels.where("toxic = 0")).collect()
    assert len(none) == 10 and all(r["score"] == 0 for r in none)


def test_toxicity_reads_whole_words(spark):
    assert {*toxicity.parts_of("a" * 500 + "vile"), *toxicity.parts_of("vile" + "a" * 90)} >= {*toxicity.parts_of("avile")} & {*toxicity.parts_of("bvile")}
    docs, labels = toxic_docs(spark)
    joined = docs.withColumn("text", F.concat(F.lit("ba" * 40 + "/"), F.regexp_replace("text", " ", "/")))
    got = toxicity.toxicity(joined, labels).collect()
    assert np.mean([r["predicted"] == (r["doc_id"] % 6 == 0) for r in got]) > 0.97


def test_toxicity_with_a_label_on_every_document(spark):
    docs, _ = toxic_docs(spark)
    labels = docs.select("doc_id", (F.col("doc_id") % 6 == 0).cast("int").alias("toxic"))
    got = toxicity.toxicity(docs, labels).collect()
    assert np.mean([r["predicted"] == (r["doc_id"] % 6 == 0) for r in got]) > 0.97


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} or ({tuple(words)} if words else set())
    comp = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if a < b and sets[a] and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    low = min(comp[a], comp[b])
                    old = {comp[a], comp[b]}
                    comp = {i: low if c in old else c for i, c in comp.items()}
                    changed = True
    return sets, comp


@pytest.mark.parametrize(("k", "percent", "large"), [(3, 85, 64), (5, 80, 64), (5, 80, 1)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, k, percent, large):
    """The last case divides every bucket of several components."""
    monkeypatch.setattr(minhash, "LARGE", large)
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(20, 120))) for i in range(40)]
    for i in range(40, 130):
        words = rows[rng.randrange(12)][1].split()
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = "neu"
        rows.append((i, " ".join(words).upper() if i % 5 == 0 else " ".join(words)))
    rows += [(200, None), (201, ""), (202, "one two"), (203, "One TWO"), (204, " ")]
    got = {r["doc_id"]: r for r in minhash.near_duplicates(odd_docs(spark, rows), k, percent).collect()}
    sets, comp = brute_components(rows, k, percent)
    assert {i: r["component_id"] for i, r in got.items()} == comp
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (comp[i] == i) for i, r in got.items())


def test_near_duplicates_with_a_passage_in_all(spark, monkeypatch):
    """Documents that have half of their words in common, and near copies of some of them."""
    monkeypatch.setattr(minhash, "LARGE", 8)
    rng = random.Random(3)
    passage = prose(rng, 60)
    rows = [(i, f"{passage} {prose(rng, 55)}") for i in range(90)]
    rows += [(100 + i, rows[i][1].replace(rows[i][1].split()[-1], "neu")) for i in range(20)]
    seen = []
    fine = minhash._fine_keys
    monkeypatch.setattr(minhash, "_fine_keys", lambda *a: seen.append(a) or fine(*a))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(odd_docs(spark, rows), 3, 85).collect()}
    assert seen and got == brute_components(rows, 3, 85)[1] and sum(i != c for i, c in got.items()) == 20
    assert (1 - 0.85**minhash.FINE_ROWS) ** minhash.fine_bands(85) <= 1e-6 and minhash.fine_bands(100) == 1


def test_near_duplicates_of_ids_with_several_texts(spark):
    """A document of several texts links what any of them is linked with; copies and ids of one text beside it."""
    rng = random.Random(11)
    base = [prose(rng, 60) for _ in range(8)]
    near = lambda t: " ".join([*t.split()[:-1], "neu"])
    rows = [(5, base[0]), (5, base[1]), (2, near(base[1])), (9, near(base[0])), (9, base[2]), (7, near(base[2])), (7, near(base[2])), (1, base[3]), (8, base[4]), (8, None), (3, base[4]), (6, "a b"), (6, ""), (4, base[5]), (4, base[0])]
    got = minhash.near_duplicates(odd_docs(spark, rows), 3, 85).collect()
    want = {5: 2, 2: 2, 9: 2, 7: 2, 4: 2, 1: 1, 8: 3, 3: 3, 6: 6}
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == sorted((i, want[i], want[i] == i) for i, _ in rows)
    one = minhash.near_duplicates(odd_docs(spark, [(1, base[0]), (1, base[1]), (2, "x y z"), (3, near(base[1]))]), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in one} == {1: 1, 2: 2, 3: 1}


def test_near_duplicates_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, 3, 85).collect()), key=repr)
    assert got == sorted([(None, None, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (5, 5, True), (6, 5, False), (7, 7, True), (8, 8, True)], key=repr)
    assert minhash.drop_near_duplicates(docs).columns == docs.columns


def test_sketch_filters_keep_true_links():
    rng = np.random.default_rng(4)
    for _ in range(50):
        common, extra = rng.integers(0, 2**63, 170, dtype=np.uint64), rng.integers(0, 2**63, 30, dtype=np.uint64)
        a, b = np.unique(np.r_[common, extra[:15]]), np.unique(np.r_[common, extra[15:]])
        differ = lambda x, y: int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
        assert differ(minhash.odd_sketch(minhash.min_hashes(a)), minhash.odd_sketch(minhash.min_hashes(b))) <= minhash.sketch_limit(0.85)
        assert differ(minhash.parities(a), minhash.parities(b)) <= 30


def test_pipeline_follows_its_stages(spark, tmp_path):
    docs, labels = toxic_docs(spark, 300)
    clean = docs.where("doc_id % 6 <> 0")
    copies = clean.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 1000)
    junk = clean.where("doc_id < 30").select(*[F.regexp_replace("text", " ", "### ").alias("text") if c == "text" else (F.col("doc_id") + 2000).alias("doc_id") if c == "doc_id" else F.col(c) for c in docs.columns])
    docs.unionByName(copies).unionByName(junk).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not any(1000 <= i for i in ids)
    want = {i for i in range(300) if i % 6}
    assert len(ids & want) >= 0.97 * len(want) and len({i for i in ids if i % 6 == 0}) <= 3
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "MinHash near-dedup", "best-fit packing"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    """Whole results on the smallest tables against DuckDB's."""
    duckdb = pytest.importorskip("duckdb")
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df, sql = queries.QUERIES[name](spark, data), con.sql(queries.ORACLE_SQL[name])
    cols = sorted(df.columns)
    at = [sql.columns.index(c) for c in cols]
    assert sorted(sql.columns) == cols
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in sql.fetchall()), key=repr)


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py"
