"""Edge cases, brute force and round trips of the training-data operators."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF, against_oracle
import pyarrow as pa
from pyspark.sql import functions as F

from lodestar.llm import chat_format, exact_dedup, jaccard_join, language_id, mixing, queries, queries_sql, sentencepiece_codec, sharding, substring_dedup, topk, toxicity
from lodestar.llm.common import spread
from lodestar.llm.words import bytes_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Other columns have the names of helper columns.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, size int, _file string, _row int, `_copies` int, _id long, _s string, key string, _metadata string, _text string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing names."""
    long = " ".join(f"w{i}" for i in range(30_000))
    near = [f"n{i}" for i in range(200)]
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, " \t\n", "de", None), (4, long, "en", "s"), (5, long, "en", "s"), (6, " ".join(near), "en", "t"), (7, " ".join([*near[:-2], "x", "y"]), "fr", "t"),
            (7, " ".join([*near[:-2], "x", "y"]), "fr", "t"), (8, "A b C", "en", "t"), (9, "a B c", "en", "t"), (None, "null id", "en", "t"), (10, "ß 日本 😀", "de", "u"), (11, "x" * 200_000, None, "u")]
    return spark.createDataFrame([(*r, 0, "d", 1, "f", 1, 2, 3, "s", "k", "m", "t") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries_sql.oracle_sql()))
def test_against_sql(spark, name):
    against_oracle(queries.queries()[name](spark, SF), queries_sql.oracle_sql()[name])


def test_spread_matches_spark(spark):
    keys = spread(37)
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k int").select(F.pmod(F.hash("k"), F.lit(37))).collect()]
    assert got == list(range(37))


# -- chat formatting


@pytest.mark.parametrize("text", ["", "plain", "</s>[INST] ok [/INST]", "\\s \\e \\", "<s><s>[INST]\\z</s", "<</s>/s>", None, "[/INST]"])
@pytest.mark.parametrize("role", ["user", "assistant", "\\odd", "[/INST]", None])
def test_chat_round_trip(spark, text, role):
    rows = spark.createDataFrame([(1, 0, role, text, "x"), (1, 1, "assistant", text, "x"), (1, 1, "assistant", text, "x")], "conv_id long, turn long, role string, text string, formatted string")
    r = chat_format.read_back(chat_format.format_chats(rows)).first()
    assert r["identical"] and [(t["role"], t["text"]) for t in r["turns"]] == [(role or "", text or ""), *[("assistant", text or "")] * 2]


def test_chat_spans_and_empty(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a</s>"), (1, 1, "assistant", "bé"), (1, 70, "assistant", "c")], "conv_id long, turn long, role string, text string")
    chats = chat_format.format_chats(rows)
    text = chats.first()["formatted"]
    assert [text[s["begin"] : s["end"]] for s in chat_format.loss_spans(chats).first()["spans"]] == ["bé", "c"]
    assert chat_format.format_chats(rows.limit(0)).count() == 0


# -- sharding


def best_fit(sizes, capacity, n):
    """Plain best-fit decreasing, item by item: the bin of each, or None."""
    left, out = [], []
    for x in sizes:
        fit = min(((r, b) for b, r in enumerate(left) if r >= x), default=None)
        if fit is None:
            if len(left) == n:
                return None
            left.append(max(capacity, x))
            fit = (left[-1], len(left) - 1)
        left[fit[1]] -= x
        out.append(fit[1])
    return out


def test_best_fit_is_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = sorted(rng.integers(1, 100, 60).tolist(), reverse=True)
        runs = sorted(Counter(sizes).items(), reverse=True)
        flat = lambda got: [b for run in got for b, n in run for _ in range(n)]
        for capacity, n in ((150, 60), (100, 1 << 60)):
            assert flat(sharding.pack(runs, capacity, n)) == best_fit(sizes, capacity, n)
        even = flat(sharding.pack_evenly(runs, 8))
        least = next(c for c in range(max(sizes), 10_000) if best_fit(sizes, c, 8) is not None)
        loads = Counter()
        for s, b in zip(sizes, even):
            loads[b] += s
        assert least <= max(loads.values()) <= least + 3 or max(loads.values()) <= least


def test_every_document_in_its_best_fit_shard(spark):
    """The whole result for sf0.01 against plain best-fit decreasing of the groups."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in sharding.shard(spark, spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    size = lambda t: len((t or "").encode()) + 8
    groups = Counter()
    for r in docs:
        groups[r["text"] or ""] += size(r["text"])
    sizes = sorted(groups.values(), reverse=True)
    loads, shard_of = Counter(), {}
    for r in docs:
        loads[got[r["doc_id"]]["shard"]] += size(r["text"])
        assert shard_of.setdefault(r["text"] or "", got[r["doc_id"]]["shard"]) == got[r["doc_id"]]["shard"]
    want = Counter(zip(sizes, best_fit(sizes, max(loads.values()), 24)))
    assert Counter((groups[t], s) for t, s in shard_of.items()) == want and sorted(loads) == list(range(24))
    assert len(got) == len(docs) and all(got[r["doc_id"]]["size"] == size(r["text"]) for r in docs)


def test_shards(spark, odd, empty):
    rows = sharding.shard(spark, odd, 4).collect()
    assert len(rows) == odd.count() and sharding.shard(spark, empty).count() == 0
    by_text, slots = defaultdict(set), defaultdict(list)
    for r in rows:
        by_text[r["text_crc32"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(r["size"] <= 1 << 20 for r in rows) and sharding.shard_by_capacity(spark, odd, 1 << 20).agg(F.countDistinct("shard")).first()[0] == 1
    assert all(len(s) == 1 for s in by_text.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())


# -- exact dedup


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.length(t).cast("string")])
def test_dedup_survives_colliding_digests(spark, odd, empty, digest):
    got = exact_dedup.dedup_classes(spark, odd, digest).collect()
    by_text = defaultdict(list)
    for r in odd.collect():
        by_text[r["text"] or ""].append(r["doc_id"])
    assert sum(r["kept"] for r in got) == len(by_text) and len(got) == odd.count()
    assert Counter(r["group_size"] for r in got) == Counter(n for v in by_text.values() for n in [len(v)] * len(v))
    assert exact_dedup.dedup_classes(spark, empty).count() == 0
    assert {r["text_sha256"] for r in got} == {hashlib.sha256(t.encode()).hexdigest() for t in by_text}
    assert exact_dedup.dedup(spark, odd).columns == odd.columns and exact_dedup.dedup(spark, odd).count() == len(by_text)


def test_kept_state_goes_on(spark, tmp_path):
    at, state = str(tmp_path / "docs"), str(tmp_path / "state")
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id long, text string").coalesce(1).write.mode("append").parquet(at)
    rows((1, "a"), (2, "b"))
    assert exact_dedup.dedup_classes(spark, at, state=state).filter("kept").count() == 2
    rows((3, "a"), (0, "c"))
    got = exact_dedup.dedup_classes(spark, at, state=state).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == [(0, 0, 1, True), (1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True)]


# -- mixing


def test_mixing(spark, odd, empty):
    plan = mixing.mixing_plan(odd).collect()
    assert len(plan) == odd.count() and mixing.mixing_plan(empty).count() == 0
    assert all(0 <= r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] for r in plan)
    assert sorted(map(tuple, plan), key=str) == sorted(map(tuple, mixing.mixing_plan(odd).collect()), key=str)
    out = mixing.mix(odd)
    assert out.columns == odd.columns and sum(len(WORD.findall(r["text"] or "")) for r in out.collect()) == sum(r["taken"] for r in plan)


def test_many_sources_are_ranked_in_order(spark):
    rng = np.random.default_rng(2)
    sizes = {f"s{i:04d}": int(n) for i, n in enumerate(rng.integers(0, 500, 700))} | {None: 50}
    got = {r["source"]: r for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    low, high, total = 0.0, 1e9, sum(sizes.values()) * 1.5
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * sizes[s], mid * weight[s]) for s in names) < total else (low, mid)
    assert all(got[s]["weight"] == weight[s] and abs(got[s]["target"] - min(2 * sizes[s], high * weight[s])) < 1e-3 for s in names)


# -- language


def test_many_languages_by_codewords(spark, monkeypatch):
    rng = np.random.default_rng(4)
    alphabets = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5, replace=False)) for _ in range(9)]
    words = lambda a: " ".join("".join(rng.choice(list(a), 4)) for _ in range(30))
    rows = [(i, words(alphabets[i % 9]), f"l{i % 9}") for i in range(900)]
    monkeypatch.setattr(language_id, "TRAINED", 270)
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 9 and model.code.shape[1] >= 15
    got = language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).filter("held_out").collect()
    assert sum(r["lang_pred"] == f"l{r['doc_id'] % 9}" for r in got) / len(got) > 0.95
    # the decoder against its definition, bit by bit
    buf, offs = bytes_of(pa.array([r[1] for r in rows[:20]]))
    x = language_id.features(buf, offs)
    for row, shares in zip(x, model.scores(x)):
        loss = [sum(model.trust[b] * np.log1p(np.exp(-model.code[k, b] * (row @ model.weights[:-1, b] + model.weights[-1, b]))) for b in range(model.code.shape[1])) for k in range(9)]
        want = np.exp(-np.array(loss)) / np.exp(-np.array(loss)).sum()
        assert np.allclose(want, shares)


def test_short_texts_are_scored_in_small_slices():
    assert max(j - i for i, j, *_ in language_id.slices(np.zeros(100_000, np.uint8) + 97, np.arange(0, 100_001, 100), rows=language_id.ROWS)) == language_id.ROWS


def test_language(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95
    rows = {r["doc_id"]: r for r in language_id.identify(odd).collect()}
    assert rows[1]["lang_pred"] == rows[2]["lang_pred"] == rows[3]["lang_pred"] == "und" and 0 <= rows[10]["score"] <= 1
    assert language_id.identify(empty).count() == 0


# -- similarity


def test_components_against_brute_force(spark, odd, empty):
    docs, unlike = odd.filter("doc_id is not null"), [(None, "the null id"), (None, "e f g h i j k l m n o p"), (20, "e f g h i j k l m n o p"), (21, "e f g h i j k l m n o p")]
    extra = jaccard_join.jaccard_components(spark, spark.createDataFrame(unlike, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in extra), key=str) == sorted([(None, 1, None), (None, 8, 20), (20, 8, 20), (21, 8, 20)], key=str)
    kept = jaccard_join.representatives(spark, spark.createDataFrame([(*r, "x") for r in unlike], "doc_id long, text string, _own string")).collect()
    assert sorted((tuple(r) for r in kept), key=str) == sorted([(None, "the null id", "x"), (20, "e f g h i j k l m n o p", "x")], key=str)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in docs.collect():
        w = WORD.findall((r["text"] or "").translate(lower))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark, odd).collect()}
    assert got.pop(None) == (1, None)
    assert got == {d: (len(s), root[d]) for d, s in sets.items()} and root[7] == 6 and root[9] == 8
    assert jaccard_join.jaccard_components(spark, empty).count() == 0


def brute_components(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, postings, root = {}, defaultdict(list), {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
        root[i] = i

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, s in sets.items():
        common = Counter(j for g in s for j in postings[g])
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in s:
            postings[g].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("tokens", [jaccard_join.BLOCK_TOKENS, 300])
def test_components_of_all_documents(spark, monkeypatch, tokens):
    """Every document of sf0.01 and some near copies; also where components are cut into blocks of few tokens."""
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", tokens)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rng, words = np.random.default_rng(9), [f"v{i}" for i in range(400)]
    near = [(100_000 + i, " ".join(words[: int(rng.integers(60, 130))] + [f"z{i}"] * int(rng.integers(0, 3)))) for i in range(80)]
    rows = [tuple(r) for r in docs.collect()] + near
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark, docs.union(spark.createDataFrame(near, "doc_id long, text string"))).collect()}
    assert got == brute_components(rows)


def test_every_block_builds_the_tree(monkeypatch):
    made = []
    monkeypatch.setattr(jaccard_join, "SignatureTree", lambda sets, t=jaccard_join.SignatureTree: made.append(len(sets)) or t(sets))
    a = np.arange(1, 60, dtype=np.uint64)
    assert jaccard_join.link_forest(np.array([1, 2]), [a, a[:-1]]) == [(2, 1)] and made == [2]


def test_signature_tree_forest():
    rng = np.random.default_rng(3)
    base = [rng.integers(1, 1 << 60, 120, dtype=np.uint64) for _ in range(6)]
    sets = []
    for b in base:
        for _ in range(30):
            s = b.copy()
            at = rng.integers(0, 120, int(rng.integers(0, 16)))
            s[at] = rng.integers(1, 1 << 60, len(at), dtype=np.uint64)
            sets.append(np.unique(s))
    ids, want = np.arange(len(sets)), np.arange(len(sets))
    for _ in range(4):
        for a in range(len(sets)):
            for b in range(a):
                if jaccard_join.linked(sets[a], sets[b]):
                    want[a] = want[b] = min(want[a], want[b])
    got = np.arange(len(sets))
    for _ in range(len(sets)):
        for a, b in jaccard_join.link_forest(ids, sets):
            got[a] = got[b] = min(got[a], got[b])
        if (got == want).all():
            break
    assert (got == want).all()


# -- codec


def test_codec_is_the_models_own(spark, odd, empty):
    import sentencepiece

    path = sentencepiece_codec.default_model()
    library, codec = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(open(path, "rb").read())
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()] + ["", " ", "  a\n\tb", " x  ", "a" * 99, "ü😀 \x00z", "<s> [INST] </s>", "日本語", "==== ---- 0000"]
    got = [np.frombuffer(x, np.int32) for x in codec.encode(texts)]
    assert [x.tolist() for x in got] == library.encode(texts)
    assert [codec.decode(x).decode() for x in got] == texts
    coded = sentencepiece_codec.encode(odd)
    back = Counter(tuple(r) for r in sentencepiece_codec.decode(coded).collect())
    assert back == Counter((r["doc_id"], r["text"] or "") for r in odd.collect())
    assert sentencepiece_codec.encode(empty).count() == 0 and sentencepiece_codec.digests(odd).filter("not round_trip").count() == 0


def test_unigram_takes_the_best_path():
    codec = sentencepiece_codec.Codec.__new__(sentencepiece_codec.Codec)
    codec.kind, codec.longest, codec.unknown_score, codec.score = 1, 3, -20.0, {"a": -3.0, "b": -3.0, "ab": -4.0, "abc": -9.0, "c": -3.0}
    codec.ids, codec.bytes, codec.unknown, codec.known = {k: i for i, k in enumerate(codec.score)}, {}, 9, {}
    codec.learn({"abc", "abcb", "abd"})
    assert [np.frombuffer(codec.known[w], np.int32).tolist() for w in ("abc", "abcb", "abd")] == [[2, 4], [2, 4, 1], [2, 9]]


# -- toxicity


def test_toxicity(spark, odd, empty):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.score(docs, labels).withColumnRenamed("toxic", "said").join(labels, "doc_id").collect()
    assert sum(r["said"] == bool(r["toxic"]) for r in got) / len(got) > 0.95
    assert all(0 <= r["severity"] <= 2 and r["p_severe"] <= r["p_mild"] for r in got)
    none = labels.limit(0)
    assert toxicity.score(odd, none).filter("toxic").count() == 0 and toxicity.clean(odd, none).count() == odd.count() and toxicity.clean(empty, labels).count() == 0


def test_toxicity_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF.replace('0.01', '0.1')}/documents.parquet"), spark.read.parquet(f"{SF.replace('0.01', '0.1')}/labels.parquet")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    got = toxicity.score(docs, labels.filter(~third)).withColumnRenamed("toxic", "said").join(labels.filter(third), "doc_id").collect()
    right = sum(r["said"] and r["toxic"] == 1 for r in got)
    said, toxic = sum(r["said"] for r in got), sum(r["toxic"] == 1 for r in got)
    assert right / said > 0.9 and right / toxic > 0.65, (right, said, toxic, len(got))


def test_ordinal_likelihood_by_numbers():
    """What training climbs: its slopes against differences of the likelihood itself, and shared weights over ordered thresholds."""
    rng = np.random.default_rng(6)
    toxic = (rng.random(400) < 0.4).astype(int)
    x = rng.random((400, 30)) < np.where(toxic[:, None] == 1, np.linspace(0.1, 0.6, 30), 0.2)
    rows, feats = np.nonzero(x)
    model = toxicity.fit(rows, feats, toxic)
    grade = toxicity.grades(rows, feats, toxic)
    assert model.thresholds[0] < model.thresholds[1] and set(grade[toxic == 0]) == {0} and set(grade[toxic == 1]) == {1, 2}

    def loss(w, t):
        eta = np.array([w[model.index[feats[rows == i]][model.index[feats[rows == i]] >= 0]].sum() for i in range(400)])
        p = 1 / (1 + np.exp(-(eta[:, None] - t)))
        like = np.choose(grade, [1 - p[:, 0], p[:, 0] - p[:, 1], p[:, 1]])
        return -np.log(like + 1e-12).mean() + 5e-5 * (w * w).sum()

    at, least = loss(model.weights, model.thresholds), loss(np.zeros_like(model.weights), model.thresholds)
    assert at < least
    for i in range(len(model.weights)):
        step = np.zeros_like(model.weights)
        step[i] = 1e-4
        slope = (loss(model.weights + step, model.thresholds) - loss(model.weights - step, model.thresholds)) / 2e-4
        assert abs(slope) < 0.02


def test_training_takes_each_id_once(spark):
    docs = spark.createDataFrame([(1, "bad bad word")] * 50 + [(2, "good word")] + [(i, f"good thing {i % 7}") for i in range(3, 40)] + [(i, f"bad thing {i % 7}") for i in range(40, 80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 1 or i >= 40)) for i in range(1, 80)], "doc_id long, toxic int")
    once, again = toxicity.train(docs.dropDuplicates(), labels), toxicity.train(docs, labels)
    assert np.allclose(once.weights, again.weights) and np.allclose(once.thresholds, again.thresholds)


# -- search


def test_top_k_in_waves_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "BLOCK", 3)
    monkeypatch.setattr(topk, "LEAF", 4)
    monkeypatch.setattr(topk, "GROWTH", 2)
    rng = np.random.default_rng(8)
    for top in (2.0, 3e5, 1e13):
        rows = [(i, (rng.random(6) * top - top / 2).tolist()) for i in range(400)] + [(40, [top / 3] * 6), (7, [top / 3] * 6)]
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect())
        v = [(i, [math.floor(64 * x) for x in e]) for i, e in rows]
        want = []
        for q in sorted({i for i, _ in v if i % 20 == 0}):
            best = defaultdict(lambda: -(1 << 200))
            for i, e in v:
                for j, f in v:
                    if i == q and j != q:
                        best[j] = max(best[j], sum(a * b for a, b in zip(e, f)))
            want += [(q, n + 1, j, min(topk.LONG, max(-topk.LONG - 1, s))) for n, (j, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5])]
        if top < 1e13:
            assert got == want
        else:
            assert [(q, s) for q, _, _, s in got] == [(q, s) for q, _, _, s in want]


def test_top_k_odd_vectors(spark):
    rows = [(20, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, [2.0]), (6, [1.0, 0.5]), (6, [1.0, 0.5]), (40, [float("inf"), 0.0])]
    got = topk.top_k(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int"), k=2)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == [(20, 1, 5, 8192), (20, 2, 1, 5120)]
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# -- substrings


def test_substring_odd(spark, odd, empty):
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(spark, odd).collect()}
    assert got[4]["n_removed"] == 0 and got[5]["n_removed"] == 30_000 and got[7]["n_removed"] == 198 and got[7]["kept"] == "x y" and got[1]["n_words"] == 0
    assert substring_dedup.substring_dedup(spark, empty).count() == 0


@pytest.mark.parametrize("hot, held, frequent", [(10_000, 1 << 19, 1000), (1, 40, 1000), (1, 40, 1), (10_000, 40, 1)])
def test_removed_words_against_brute_force(spark, monkeypatch, hot, held, frequent):
    """Also where keys are replaced, tasks combine little, and few rules go to every task."""
    for name, value in (("HOT", hot), ("HELD", held), ("FREQUENT", frequent)):
        monkeypatch.setattr(substring_dedup, name, value)
    rng = np.random.default_rng(11)
    passages = [" ".join(rng.choice(list("abcdefgh"), int(rng.integers(10, 40)))) for _ in range(12)]
    docs = [(int(i), " ".join(str(x) for k in range(4) for x in (passages[int(rng.integers(0, 12))], *rng.choice(list("stuvw"), 3)))) for i in rng.permutation(60)] + [(70, "For " * 300), (71, "For " * 200), (72, passages[0]), (72, passages[0])]
    words = [(i, WORD.findall(t)) for i, t in docs]
    least = {}
    for i, w in words:
        for j in range(len(w) - 12):
            g = tuple(w[j : j + 13])
            least[g] = min(i, least.get(g, i))
    want = []
    for i, w in words:
        gone = {j + k for j in range(len(w) - 12) if least[tuple(w[j : j + 13])] < i for k in range(13)}
        want.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    got = substring_dedup.substring_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_suffix_automaton_windows():
    rng = np.random.default_rng(5)
    for _ in range(30):
        texts = [rng.integers(0, 3, int(rng.integers(4, 20))).tolist() for _ in range(5)]
        automaton = substring_dedup.SuffixAutomaton()
        for doc, t in enumerate(texts):
            automaton.add(t, doc)
        automaton.finish()
        for t in texts:
            want = [min(d for d, u in enumerate(texts) if any(u[j : j + 4] == t[i : i + 4] for j in range(len(u) - 3))) for i in range(len(t) - 3)]
            assert automaton.windows(t, 4) == want
