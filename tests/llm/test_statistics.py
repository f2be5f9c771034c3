"""Phrases, chats and clusters against brute force; odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from twinframe.llm import centroids, chats, phrases

# --- phrases ---------------------------------------------------------------------------------------------------


def brute_phrases(rows, top, least, share):
    plain = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(plain)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in f.items():
        scored = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(100 * b >= share * a for q, b in c.items() if len(q) == 3 and b >= least and p in (q[:2], q[1:])):
                continue
            cuts = [(1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            scored.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def made_texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Éa", "éa", "A", "a", "日本", "x" * 300, "z\xa0z"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(rng.choice(["en", "en", "de", None]), "".join(rng.choices(words, weights)[0] + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\r\n"]) for _ in range(rng.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize(("top", "least", "share", "first"), [(5, 3, 50, 1), (2000, 2, 50, 4), (3, 2, 80, 1), (1, 4, 20, 2)])
def test_phrases_against_brute_force(spark, top, least, share, first):
    rows = [*made_texts(top, 120), ("en", None), ("en", ""), (None, "..!"), ("fr", "un deux trois"), ("en", "same same same same"), ("en", "same same same same")]
    docs = spark.createDataFrame([(lang, text, "x", 1) for lang, text in rows], "lang string, text string, phrase string, rank int").repartition(5)
    rounds = []
    got = phrases.phrases(docs, top, least, share, first, bits=10, on_round=lambda f: rounds.append(f.count())).collect()
    assert sorted(tuple(r) for r in got) == brute_phrases(rows, top, least, share)
    assert rounds


def test_phrases_expand_what_can_still_win(spark):
    """Only few nodes have children that can reach the best ten; the rest is never counted."""
    rng = random.Random(1)
    rows = [("en", " ".join(f"v{min(int(rng.expovariate(0.05)), 150)}" for _ in range(400)) + "." + "".join(f" p{i} q{i} r{i}." for i in range(12))) for _ in range(60)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    rounds = []
    got = phrases.phrases(docs, 10, 5, 50, 1, on_round=lambda f: rounds.append(f.count())).collect()
    assert sorted(tuple(r) for r in got) == brute_phrases(rows, 10, 5, 50)
    nodes = phrases.pair_nodes(phrases.count_pairs(docs).where("c >= 5 or w1 is null")).count()
    assert sum(rounds) < nodes / 4


def test_phrases_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.phrases(empty).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and phrases.phrases(empty).count() == 0
    assert phrases.phrases(spark.createDataFrame([("en", "a b c")], "lang string, text string")).count() == 0


def test_phrases_run_on_over_chunks_and_pieces(monkeypatch):
    """Counts are the same however texts are cut into chunks and pieces, in texts without any mark too."""
    rows = [*made_texts(9, 80), ("en", "long words without any mark " * 200)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] or "und" for r in rows]), pa.array([r[1] for r in rows])], names=["lang", "text"])

    def counted():
        f = Counter()
        for lang, ids, begin, words in phrases._chunks([batch]):
            for i in range(begin):
                for k in (1, 2, 3):
                    own = ids[i : i + k]
                    if len(own) == k and (own != phrases.END).all():
                        f[lang, tuple(words[x] for x in own)] += 1
        return f

    whole = counted()
    monkeypatch.setattr(phrases, "CHUNK", 50)
    monkeypatch.setattr(phrases, "PIECE", 40)
    assert counted() == whole and sum(whole.values()) > 1000


# --- chats -----------------------------------------------------------------------------------------------------

TALKS = "conv_id bigint, turn bigint, role string, text string"


def digests(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    learnt = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()


def reread(formatted):
    """The grammar, read by hand: turns, from left to right."""
    assert formatted.startswith("<s>")
    at, turns = 3, []
    off = lambda t: re.sub(r"([\[<])\\(\\*)(/?INST\]|/?ROLE[=\]]|/?s>|</?SYS>>)", r"\1\2\3", t)
    while at < len(formatted):
        for role, (a, b) in chats.MARKS.items():
            if formatted.startswith(a, at) and (a or not formatted.startswith("[ROLE=", at)):
                end = formatted.index(b, at + len(a))
                turns.append((role, off(formatted[at + len(a) : end])))
                at = end + len(b)
                break
        else:
            close = formatted.index("] ", at)
            end = formatted.index(" [/ROLE]", close + 2)
            turns.append((formatted[at + 6 : close], off(formatted[close + 2 : end])))
            at = end + 8
    return turns


def test_chats_of_hostile_texts(spark):
    rng = random.Random(5)
    parts = ["</s>", "<s>", "[INST]", "[INST] ", " [/INST]", "<<SYS>> ", " <</SYS>>", "[ROLE=", "[ROLE=%zz] ", " [/ROLE]", "\\", "\\\\", "[", "<", "/", " ", "\n", "s>", "INST]", "[\\INST]", "<\\/s>", "<\\<SYS>>", "$1", "é😀", "x"]
    talks = [[(rng.choice(["user", "assistant", "system", "tool", "", "a] b\n", "usér"]), "".join(rng.choices(parts, k=rng.randint(0, 6)))) for _ in range(rng.randint(1, 6))] for _ in range(600)]
    rows = spark.createDataFrame([(c, i, r, t) for c, talk in enumerate(talks) for i, (r, t) in enumerate(talk)], TALKS).repartition(4)
    made = chats.format_conversations(rows)
    got = {r["conv_id"]: r for r in chats.read_back(made).collect()}
    out = {r["conv_id"]: r for r in made.collect()}
    assert len(got) == len(talks) and 100 < sum(r["escaped"] for r in out.values()) < 600
    for c, talk in enumerate(talks):
        assert tuple(got[c])[1:5] == digests(talk)
        assert "".join(s["text"] for s in out[c]["segments"]) == out[c]["formatted"] and got[c]["formatted_chars"] == len(out[c]["formatted"])
        if out[c]["escaped"] and not any(r in ("", "a] b\n", "usér") for r, _ in talk):
            assert reread(out[c]["formatted"]) == talk


def test_chats_escape_is_reversible(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices("[<\\/INSTROLE=s>Y] ", k=rng.randint(0, 12))) for _ in range(3000)] + ["[" + "\\" * i + m for i in range(4) for m in ("INST]", "/INST]", "ROLE=", "/ROLE]")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.select((chats.unescape(chats.escape(df.t)) == df.t).alias("same")).where("not same").count() == 0


def test_chats_of_odd_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 0, "user", None), (2, None, None, "x"), (2, 3, "assistant", ""), (None, 0, "user", "hi"), (-1, 0, "user", "own")]
    df = spark.createDataFrame([(*r, "z", 7) for r in rows], TALKS + ", own_ string, formatted int")
    got = sorted((tuple(r)[:5] for r in chats.read_back(chats.format_conversations(chats.with_odd_one(df))).collect()), key=repr)
    want = [(1, *digests([("user", ""), ("user", ""), ("assistant", "b")])), (2, *digests([("", "x"), ("assistant", "")])), (None, *digests([("user", "hi")])), (-1, *digests([("user", "own")])), (-1, *digests([("user", chats.ODD), ("assistant", chats.ODD)]))]
    assert got == sorted(want, key=repr)
    assert chats.format_conversations(df.where("false")).count() == 0
    assert [r["conv_id"] for r in chats.read_back(chats.format_conversations(chats.with_odd_one(df.where("false")))).collect()] == [-1]


def test_chats_of_long_texts(spark):
    """A misread text of a megabyte is given up in one pass."""
    long = "[INST] x [/INST] " + "no end " * 150_000
    rows = spark.createDataFrame([(1, 0, "user", long), (1, 1, "user", long)], TALKS)
    assert tuple(chats.read_back(chats.format_conversations(rows)).first())[1:5] == digests([("user", long)] * 2)


def test_chats_use_no_python(spark):
    plan = chats.read_back(chats.format_conversations(chats.with_odd_one(spark.createDataFrame([], TALKS))))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- clusters --------------------------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, dims):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) and abs(x) < 2**20 for x in v)]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:k]
    cs = [q for _, q in seeds]
    nearest = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        by = defaultdict(list)
        for _, q in kept:
            by[nearest(q)[1]].append(q)
        cs = [[sum(x) // len(x) for x in zip(*by[j], strict=True)] if j in by else c for j, c in enumerate(cs)]
    last = [(i, *nearest(q)[::-1]) for i, q in kept]
    sums = Counter()
    for _, c, d in last:
        sums[c] += d
    return sorted(((i, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, c, d in last), key=repr)


@pytest.mark.parametrize(("dims", "lead", "scale"), [(6, 2, 1.0), (5, 5, 1000.0), (4, 1, 0.02)])
def test_clusters_against_brute_force(spark, dims, lead, scale):
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(7, dims)) * 2
    rows = [(i, [float(np.float32(x)) for x in (centres[i % 7] + rng.normal(size=dims) * 0.4) * scale]) for i in range(300)]
    bad = [None, [], [1.0] * (dims - 1), [None, *[1.0] * (dims - 1)], [float("nan"), *[1.0] * (dims - 1)], [float("inf"), *[1.0] * (dims - 1)], [3e38, *[0.0] * (dims - 1)]]
    rows += [(1000 + i, v) for i, v in enumerate(bad)] + rows[:5] + [(None, [0.5] * dims), (2000, [0.0] * dims), (2001, [0.0] * dims)]
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id bigint, embedding array<double>, q string, cluster int").repartition(6)
    got = centroids.cluster_report(df, k=16, rounds=3, dims=dims, lead=lead)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_clusters(rows, 16, 3, dims)


def test_clusters_of_few_or_equal_vectors(spark):
    kind = "vec_id bigint, embedding array<float>"
    assert centroids.cluster_report(spark.createDataFrame([], kind)).count() == 0
    assert centroids.cluster_report(spark.createDataFrame([(None, [1.0] * 64)], kind)).count() == 0
    rows = [(i, [1.0] * 64) for i in range(40)]
    assert sorted((tuple(r) for r in centroids.cluster_report(spark.createDataFrame(rows, kind)).collect()), key=repr) == brute_clusters(rows, 16, 3, 64)
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert sorted((tuple(r) for r in centroids.cluster_report(spark.createDataFrame(few, kind)).collect()), key=repr) == brute_clusters(few, 16, 3, 64)


def test_bounds_never_pass_distances_and_skip_most():
    rng = np.random.default_rng(2)
    centres = rng.integers(-60, 60, (12, 64))
    for scale in (1, 1 << 18):
        q = (centres[rng.integers(0, 12, 2000)] + rng.integers(-9, 9, (2000, 64))) * scale
        c = q[:16]
        mean = q.mean(axis=0)
        axes = np.linalg.eigh(np.cov((q - mean).T.astype(float)))[1][:, ::-1]
        turn = centroids.Rotation(mean, axes, 16)
        true = ((q[:, None] - c[None]) ** 2).sum(axis=2)
        assert (centroids.lower_bounds(*turn(q), *turn(c)) <= true).all()
        best, distance, measured = centroids.nearest(q, *turn(q), c, *turn(c))
        assert (best == true.argmin(axis=1)).all() and (distance == true.min(axis=1)).all()
        assert measured < 4 * len(q)
