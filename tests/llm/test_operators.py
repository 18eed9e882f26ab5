"""The training-data operators against brute force, round trips, libraries and held-out rows, edge cases included."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import anchors, byte_bpe, exact_dedup, jaccard_join, language_id, packing, phrase_dedup, quality, suffix_dedup, token_counts, toxicity, wordhash
from lectern.llm.common import fold, labels, written
from lectern.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], schema).repartition(3)


def phrases(rng, words, n, longest=12):
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, longest))) for _ in range(n)]


def messy(seed=3, n=60):
    """Texts of recurring phrases, with nulls, empties, ties, odd white space and one long text."""
    rng = random.Random(seed)
    ph = phrases(rng, ["the", "of", "x\x85y", "é\xa0z", "b\nc", "\td", "Word", "wörd", "漢字"], 15)
    texts = [(i, " ".join(rng.choice(ph) for _ in range(rng.randint(0, 9)))) for i in range(n)]
    return texts + [(100, None), (101, ""), (102, " \n "), (103, "a"), (104, "ab " * 400), (105, "ab " * 400), (106, "x" * 3000)]


@pytest.fixture(scope="module")
def texts():
    return messy()


def test_quality_counts_match_brute_force(spark, texts):
    out = {r.doc_id: r for r in quality.ruled(frame(spark, texts), spark.createDataFrame([(3,), (None,)], "doc_id long")).collect()}
    assert len(out) == len(texts)
    for i, t in texts:
        t = t or ""
        w = WORD.findall(t)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {j + k for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        got = out[i]
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == (len(w), sum(map(len, w)), sum(x in quality.SYMBOLS for x in t), len(lines) - len(set(lines)), len(hit))
        assert got.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (got.base_failed and got.kept)


def test_quality_ratio_matches_brute_force(spark):
    texts = [(i, f"good text number {i} " + "alpha beta " * 30) for i in range(8)] + [(9, "| junk | " * 40)]
    cells = 64
    out = {r.doc_id: r.llr for r in quality.ruled(frame(spark, texts), spark.createDataFrame([(0,), (1,)], "doc_id long"), cells=cells).collect()}
    signed = lambda b, seed=42: int(np.uint64(xxhash.xxh64_intdigest(b, seed)).view(np.int64))

    def features(t):
        h = [signed(w.encode()) for w in WORD.findall(t)]
        pair = lambda a, b: signed(b.to_bytes(8, "little", signed=True), signed(a.to_bytes(8, "little", signed=True)) % (1 << 64))
        return [x % cells for x in h] + [pair(a, b) % cells for a, b in zip(h, h[1:], strict=False)]

    raw, good = Counter(), Counter()
    for i, t in texts:
        raw.update(features(t))
        if i < 2:
            good.update(features(t))
    n, m, prior = sum(raw.values()) + cells, sum(good.values()), quality.PRIOR * cells
    weight = [np.log((good[c] + prior * (raw[c] + 1) / n) / (m + prior) / ((raw[c] + 1) / n)) for c in range(cells)]
    for i, t in texts:
        f = features(t)
        assert abs(out[i] - sum(weight[c] for c in f) / len(f)) < 1e-4
    assert out[9] < out[0]


def test_byte_bpe_is_the_library(spark, texts):
    import tiktoken

    file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = byte_bpe.ByteBpe(file, public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    odd = [t or "" for _, t in texts] + ["<|endoftext|>", " a", "a ", "a  b", "foo \nbar", "foo\n bar", "aaaa" * 50, "it's we'll\x1c x"]
    for t, (decimal, ids) in zip(odd, own.encode(pa.array(odd)), strict=True):
        assert ids.tolist() == lib.encode_ordinary(t) and decimal == ",".join(map(str, ids.tolist())) and own.decode(ids) == t.encode()
    out = byte_bpe.encoded(frame(spark, texts), file, public_tokenizers.PATTERN).collect()
    for r in out:
        t = dict(texts)[r.doc_id] or ""
        assert r.ids == lib.encode_ordinary(t) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()


def test_piece_counts_are_the_library(spark, texts):
    import sentencepiece

    file = public_tokenizers.path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=file), token_counts.PieceCounter(file)
    rng = random.Random(2)
    odd = ["".join(rng.choice("abth e \n▁é漢🙂<s>0") for _ in range(rng.randint(0, 30))) for _ in range(400)] + ["  ", " x", "x  y ", "</s>", "ab" * 700]
    assert own.count(pa.array(odd)).tolist() == [len(x) for x in lib.encode(odd)]
    for r in token_counts.token_counts(frame(spark, texts), file, limit=100).collect():
        t = dict(texts)[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(lib.encode(t)), len(lib.encode(t)) > 100)


def test_packing_is_exact_and_unpadded(spark, texts):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(file)
    texts = [*texts, (200, "odd\x1cgap <|endoftext|> İΣ"), (201, "word " * 700)]
    out = packing.packed(frame(spark, texts), file, capacity=256).toPandas()
    for _, p in out.groupby("sequence_id"):
        p = p.sort_values("offset")
        total = int(p.length.sum())
        assert p.offset.tolist() == (p.length.cumsum() - p.length).tolist() and total <= 256 and total & (total - 1) == 0
    assert set(out.doc_id) == {i for i, _ in texts}
    for d, p in out.groupby("doc_id"):
        p = p.sort_values("start")
        ids = [*lib.encode(dict(texts)[d] or "", add_special_tokens=False).ids, 2]
        assert p.start.tolist() == (p.length.cumsum() - p.length).tolist() and p.length.sum() == len(ids) == p.doc_tokens.iloc[0]
        for r in p.itertuples():
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32


def test_packing_balances_cost():
    pieces, left = packing.assign([90, 60, 50, 40, 30, 20, 10], 100, 1.0, 0.01)
    assert sum(p[2] for p in pieces) == 300 and not left
    used = Counter()
    for _, _, n, k in pieces:
        used[k] += n
    assert set(used.values()) == {100}


def brute_bytes(texts, length):
    first, out = {}, {}
    for d, t in sorted(texts):
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], (d, i))
    for d, t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] != (d, i):
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("length,many", [(100, anchors.MANY), (40, 2)])
def test_suffix_dedup_matches_brute_force(spark, texts, length, many):
    out = suffix_dedup.substring_free(frame(spark, texts), length, many=many).collect()
    expected = brute_bytes(texts, length)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == expected
    assert sum(x[1] for x in expected.values()) > 0
    assert all(r.kept_text is not None for r in out)


def test_suffix_dedup_sorts_only_what_recurs(monkeypatch):
    """A line shorter than the length in many texts brings their snippets together, but of these only equal strings are sorted."""
    rng = random.Random(11)
    line, own = bytes(rng.choices(b"abc ", k=76)), lambda n: bytes(rng.choices(range(97, 123), k=n))
    rows = [(7, i, 10 * i, own(60) + line + own(60)) for i in range(300)]
    rows += [(7, 300, 5, rows[40][3][50:170]), (7, 301, 0, rows[40][3][30:131]), (8, 302, 0, own(150)), (9, 303, 0, b"x" * 130), (9, 303, 200, b"x" * 100)]
    first, expected = {}, set()
    for _, doc, start, raw in rows:
        for k in range(len(raw) - 99):
            if first.setdefault(raw[k : k + 100], (doc, start + k)) != (doc, start + k):
                expected |= {(doc, start + k + j) for j in range(100)}
    sizes, order = [], suffix_dedup.suffix_order
    monkeypatch.setattr(suffix_dedup, "suffix_order", lambda data, depth: sizes.append(len(data)) or order(data, depth))
    monkeypatch.setattr(suffix_dedup, "snippets", lambda open_, *_: open_)
    monkeypatch.setattr(suffix_dedup, "map_arrow", lambda batches, run, _: list(run(iter(batches))))
    resolve = suffix_dedup.resolver(anchors.Windows(100, 32, within=True))
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["key", "doc", "start", "snippet"])
    found = [r for b in resolve([batch]) for r in b.to_pylist()]
    assert {(r["doc"], at) for r in found for at in range(r["start"], r["end"])} == expected
    assert 0 < sum(sizes) < 1_000
    assert not resolve([batch.slice(0, 40)])[0].num_rows


def test_long_intervals_on_random_text():
    rng = random.Random(4)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(400)), np.uint8)
    order, begins = suffix_dedup.long_intervals(data, 6)
    raw = data.tobytes()
    assert sorted(raw[i:] for i in range(400)) == [raw[i:] for i in order] or all(raw[a : a + 8] <= raw[b : b + 8] for a, b in zip(order, order[1:], strict=False))
    for k in range(1, 400):
        a, b = raw[order[k - 1] :][:6], raw[order[k] :][:6]
        assert begins[k] == (a != b or len(a) < 6)


@pytest.mark.parametrize("many", [anchors.MANY, 2])
def test_phrase_dedup_matches_brute_force(spark, texts, many):
    length, least = 6, {}
    words = {d: WORD.findall(t or "") for d, t in texts}
    for d, w in words.items():
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            least[k] = min(least.get(k, d), d)
    total = 0
    for r in phrase_dedup.phrase_free(frame(spark, texts), length, many=many).collect():
        w = words[r.doc_id]
        gone = [0] * len(w)
        for i in range(len(w) - length + 1):
            if least[tuple(w[i : i + length])] < r.doc_id:
                gone[i : i + length] = [1] * length
        rest = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        total += sum(gone)
        assert (r.n_words, r.n_removed, r.kept_text, r.kept_sha256) == (len(w), sum(gone), rest, hashlib.sha256(rest.encode()).hexdigest())
    assert total > 0


def test_exact_groups(spark, texts):
    same: dict[str, list[int]] = {}
    for d, t in texts:
        same.setdefault(t or "", []).append(d)
    for r in exact_dedup.exact_groups(frame(spark, texts)).collect():
        t = dict(texts)[r.doc_id] or ""
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(same[t]), len(same[t]), r.doc_id == max(same[t]), hashlib.sha256(t.encode()).hexdigest())


def test_chunks_join_to_the_text_and_follow_content(spark):
    rng = random.Random(1)
    body = " ".join("".join(rng.choice("aeionrst") for _ in range(6)) for _ in range(3000))
    cut = lambda t: spark.createDataFrame([(t,)], "t string").select(exact_dedup.chunks(F.col("t"))).head()[0]
    a, b = cut(body), cut("inserted " * 3 + body)
    assert "".join(a) == body and len(set(a) & set(b)) > len(a) // 2 and cut("") == []


def brute_groups(texts, size, percent):
    sets = {}
    for d, t in texts:
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
        sets[d] = set() if not w else {tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_near_groups_match_brute_force(spark, texts, size, percent):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    near = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 30, 90, 200]))]
        for _ in range(rng.choice([1, 2, 4])):
            w = list(base)
            for _ in range(int(len(w) * rng.choice([0, 0.01, 0.03, 0.05]))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            near.append((1000 + len(near), " ".join(w).title()))
    own = [*texts, *near]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_groups(frame(spark, own), size, percent).collect()} == brute_groups(own, size, percent)


def test_bit_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        both, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in rng.integers(1, 300, 3))
        x, y = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
        s, t = jaccard_join.bit_sketch(x, 85), jaccard_join.bit_sketch(y, 85)
        size = min(len(s), len(t))
        apart = int(np.bitwise_count(jaccard_join.unfolded(s, size) ^ jaccard_join.unfolded(t, size)).sum())
        assert apart <= len(np.setxor1d(x, y))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 40)], "a long, b long")
    assert {r.node: r.component for r in components(edges).collect()} == {i: 1 for i in range(1, 31)} | {50: 40, 40: 40}


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.languages(docs, teaches=fold("doc_id", 4) != 2).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 200 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.98 and all(0 <= r.score <= 1 for r in out)


def test_language_ranks_match_brute_force(spark):
    docs = frame(spark, [(1, "Hello, world! hello"), (2, "hello 12 hello")])
    counts: Counter = Counter()
    for t in ("hello, world! hello", "hello 12 hello"):
        s = re.sub(r"[\W\d_]+", "\x01", "\x01" + t + "\x01")
        for n in (1, 2, 3):
            for i in range(len(s) - n + 1):
                g = s[i : i + n]
                if g != "\x01" and not (n == 3 and g[1] == "\x01"):
                    counts[sum(ord(c) << 21 * (n - 1 - k) for k, c in enumerate(g))] += 1
    top = [k for k, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:10]]
    model = language_id.learn(docs, top=10)
    keys, order = model.tables[0]
    assert [int(k) for k in keys[np.argsort(order)]] == top
    assert model.predict("12 !") == ("und", 0.0)


def test_toxicity_finds_planted_expressions(spark):
    rng = random.Random(6)
    vocabulary = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, marks = [], []
    for i in range(500):
        w = [rng.choice(vocabulary) for _ in range(60)]
        if i % 5 == 0:
            for _ in range(3):
                w.insert(rng.randrange(60), "vilething" + rng.choice(["er", "ing", "s"]))
        rows.append((i, " ".join(w)))
        if i % 3:
            marks.append((i, int(i % 5 == 0)))
    rows += [(900, None), (901, "")]
    marks = spark.createDataFrame([*marks, (None, 1), (7, None)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.toxic_scores(frame(spark, rows), marks, **toxicity.default_folds()).collect()}
    wrong = [i for i in range(500) if out[i].predicted != int(i % 5 == 0)]
    assert len(wrong) <= 5 and out[900].predicted == out[901].predicted == 0 and all(0 <= r.score <= 1 for r in out.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out.values())
    left = toxicity.without_toxic(frame(spark, rows), marks, **toxicity.default_folds())
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"] and left.count() == sum(not r.predicted for r in out.values())


def test_toxicity_keeps_each_word_apart(spark):
    """Words of one stem whose hashes agree in their low 20 bits; counts are those of plain Python."""
    met = {}
    for i in range(20_000):
        word = f"stems{i}"
        got = met.setdefault(int(toxicity.words_of([word.encode()], toxicity.NO_WORD)[0][0]) & 0xFFFFF, word)
        if got != word:
            break
    rows = [(f"{word} plain text {'rare' * (i == 3)}", 1) for i in range(20)] + [(f"{got} plain text", 0) for i in range(20)]
    model = toxicity.learn(spark.createDataFrame(rows, "text string, toxic int"))
    bad, good, new = model.values([word, got, "stemsnew"])
    assert bad > new > good
    counts = [Counter(w for t, toxic in rows if toxic == c for w in t.split()) for c in (0, 1)]
    for w in {*counts[0], *counts[1]}:
        own, stem, _ = toxicity.hashes([w])
        at = toxicity.places_in(model.word_keys, own)[0]
        assert tuple(model.word_n[:, at]) == (tuple(c[w] for c in counts) if w != "rare" else (0, 0))
        at = toxicity.places_in(model.stem_keys, stem)[0]
        assert tuple(model.stem_n[:, at]) == tuple(sum(n for x, n in c.items() if x[:5] == w[:5]) for c in counts)
        assert tuple(model.freed[:, at]) == tuple(sum(min(n, 2) for x, n in c.items() if x[:5] == w[:5]) for c in counts)


def test_toxicity_matches_brute_force(spark):
    """Kneser-Ney likelihoods of both classes in plain Python, and the values of whole texts."""
    rng = random.Random(12)
    vocabulary = [a + b for a in ("plain", "other", "words", "tiny", "xé") for b in ("", "er", "ing", "s", "lich")]
    rows = [(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12))) + " vile" * (i % 4 == 0), int(i % 4 == 0)) for i in range(60)]
    model = toxicity.learn(spark.createDataFrame(rows, "text string, toxic int"))
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    stem = lambda w: w.encode()[: toxicity.STEM_BYTES]
    d = toxicity.DISCOUNT
    n = [Counter(w for t, c in rows if c == k for w in split(t)) for k in (0, 1)]
    of_stem = [Counter() for _ in (0, 1)]
    freed = [Counter() for _ in (0, 1)]
    for k in (0, 1):
        for w, x in n[k].items():
            of_stem[k][stem(w)] += x
            freed[k][stem(w)] += min(x, d)
    seen = Counter(w for t, _ in rows for w in set(split(t)))
    stems = Counter()
    for w, x in seen.items():
        stems[stem(w)] += x

    def likelihood(k, w):
        s = stem(w)
        base = (stems[s] + 1) / (sum(stems.values()) + len(stems) + 1)
        p = (max(of_stem[k][s] - d, 0) + sum(min(x, d) for x in of_stem[k].values()) * base) / sum(of_stem[k].values())
        rare = max(n[0][w], n[1][w]) <= d  # then its backoff is one number for both classes
        shared = ((0 if rare else seen[w]) + 0.1) / (stems[s] + 1)
        return p * ((max(n[k][w] - d, 0) + freed[k][s] * shared) / of_stem[k][s] if of_stem[k][s] else shared)

    for t in [t for t, _ in rows] + ["vile new plainish", "", "vile", "Plain, OTHER-words"]:
        w = split(t)
        for share in (0.003, 0.1):
            got = model.values([t], (share,))[0][0]
            mean = [np.log(1 - share + share * likelihood(1, x) / likelihood(0, x)) for x in w]
            assert np.isnan(got) if not w else abs(got - sum(mean) / len(w)) < 1e-9


def test_toxicity_counts_beyond_32_bits(spark):
    """Occurrences of one class never spill into the other's."""
    counts = spark.createDataFrame([(1, 10, 1 << 40, 0, 5), (1, 11, 3, (1 << 33) + 7, 5)], "stem long, word long, plain long, toxic long, texts long")
    out = {(r.is_word, r.key): (r.plain, r.toxic, r.freed_plain, r.freed_toxic) for r in toxicity.table_rows(counts).collect()}
    assert out == {(True, 10): (1 << 40, 0, 2, 0), (True, 11): (3, (1 << 33) + 7, 2, 2), (False, 1): ((1 << 40) + 3, (1 << 33) + 7, 4, 2)}


def test_toxicity_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    out = toxicity.toxic_scores(spark.read.parquet(f"{sf}/documents.parquet"), labels(spark, sf), **toxicity.default_folds()).where("held_out").join(labels(spark, sf), "doc_id").collect()
    hit = sum(r.predicted and r.toxic for r in out)
    assert hit / sum(r.toxic for r in out) > 0.85 and hit / sum(r.predicted for r in out) > 0.85


def test_fallback_beside_the_broadcast(spark):
    from lectern.llm.common import joined_to_labels

    docs, marks = frame(spark, [(1, "a"), (2, "b")]), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    for rows in (10, 0):
        assert [r.doc_id for r in joined_to_labels(docs, marks, "inner", rows).collect()] == [1]


OPERATORS = {
    "quality": lambda s, d: quality.ruled(d, s.createDataFrame([(1,)], "doc_id long")),
    "byte_bpe": lambda s, d: byte_bpe.encoded(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
    "suffix": lambda s, d: suffix_dedup.substring_free(d, 20),
    "language": lambda s, d: language_id.languages(d, teaches=fold("doc_id", 4) != 2),
    "toxicity": lambda s, d: toxicity.toxic_scores(d, s.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), **toxicity.default_folds()),
    "exact": lambda s, d: exact_dedup.exact_groups(d),
    "phrase": lambda s, d: phrase_dedup.phrase_free(d, 4),
    "near": lambda s, d: jaccard_join.near_groups(d),
    "counts": lambda s, d: token_counts.token_counts(d, public_tokenizers.path("piece_bpe_32k.model")),
}


SAME = "some text " * 9
ODD_ROWS = [(1, SAME, "en", "s", 1), (1, SAME, "en", "s", 1), (2, None, None, None, None), (None, SAME, None, "s", 3), (3, SAME, "de", "s", 3), (4, "", "en", "s", 0)]


def odd_values(name):
    """(doc_id, values) of every row of ``ODD_ROWS``, for operators whose values follow from their contract alone."""
    import sentencepiece
    import tiktoken

    digest = lambda b: hashlib.sha256(b).hexdigest()
    ids = [r[0] for r in ODD_ROWS]
    raw = [(r[1] or "").encode() for r in ODD_ROWS]
    full = [bool(b) for b in raw]
    if name == "quality":
        return "n_words n_repeat_words base_failed kept", [(i, 18 * f, 18 * f, True, False) for i, f in zip(ids, full, strict=True)]
    if name == "byte_bpe":
        lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ByteBpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).ranks, special_tokens={})
        coded = [lib.encode_ordinary(b.decode()) for b in raw]
        return "n_tokens ids_sha256 decoded_sha256", [(i, len(c), digest(",".join(map(str, c)).encode()), digest(b)) for i, c, b in zip(ids, coded, raw, strict=True)]
    if name == "suffix":  # a row without an id comes first; its text recurs within itself after ten bytes
        gone = [0 if not f else 80 if i is None else 90 for i, f in zip(ids, full, strict=True)]
        return "n_bytes n_removed n_spans kept_sha256", [(i, len(b), g, int(g > 0), digest(b[: len(b) - g])) for i, b, g in zip(ids, raw, gone, strict=True)]
    if name == "phrase":
        gone = [18 if f and i is not None else 0 for i, f in zip(ids, full, strict=True)]
        return "n_words n_removed kept_sha256", [(i, 18 * f, g, digest(b"" if g else b.strip())) for i, f, g, b in zip(ids, full, gone, raw, strict=True)]
    if name == "exact":
        return "keep_id group_size kept text_sha256", [(i, 3 if f else 4, 4 if f else 2, i in (3, 4), digest(b)) for i, f, b in zip(ids, full, raw, strict=True)]
    if name == "near":  # the smallest id of a group with a row without one is none
        return "n_shingles component_id", [(i, 2 * f, None if f else i) for i, f in zip(ids, full, strict=True)]
    if name == "counts":
        lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        return "n_bytes n_tokens over_limit", [(i, len(b), len(lib.encode(b.decode())), False) for i, b in zip(ids, raw, strict=True)]
    return None


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, name):
    """Empty tables, null ids and languages, repeated rows, clashing names: one row out for each row in, with its values."""
    clashing = SCHEMA + ", n_words long, key long, doc long, score double, kept boolean, ranges string, name string"
    more = (0, 0, 0, 0.0, True, "r", "n")
    out = OPERATORS[name](spark, spark.createDataFrame([r + more for r in ODD_ROWS], clashing))
    assert OPERATORS[name](spark, spark.createDataFrame([], clashing)).count() == 0
    expected = odd_values(name)
    if expected:
        found = out.select("doc_id", *expected[0].split()).collect()
        assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected[1]))
        return
    own = "lang_pred" if name == "language" else "predicted"
    found = [(r.doc_id, r[own], r.score) for r in out.collect()]
    assert sorted(str(r[0]) for r in found) == sorted(str(r[0]) for r in ODD_ROWS) and all(0 <= r[2] <= 1 for r in found)
    assert len({r[1:] for r in found if r[0] not in (2, 4)}) == 1 and len({r[1:] for r in found if r[0] in (2, 4)}) == 1
    if name == "language":
        assert {r[1:] for r in found if r[0] in (2, 4)} == {("und", 0.0)}


def test_very_long_texts(spark):
    """A text longer than any block of the operators, and a part of it that lies across the ends of their blocks."""
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    rng = random.Random(14)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    long = " ".join(rng.choice(vocabulary) for _ in range(360_000))
    assert len(long) > anchors.SEGMENT + 50_000
    part = long[anchors.SEGMENT - 2500 : anchors.SEGMENT + 2500]
    texts = [(1, long), (2, part), (3, "tiny")]
    docs = frame(spark, texts)
    for r in suffix_dedup.substring_free(docs, 100, keep_text=False).collect():
        assert (r.n_bytes, r.n_removed) == (len(dict(texts)[r.doc_id]), 5000 if r.doc_id == 2 else 0)
    words = {d: WORD.findall(t) for d, t in texts}
    whole = len(words[2]) - sum(1 for w, at in ((words[2][0], anchors.SEGMENT - 2501), (words[2][-1], anchors.SEGMENT + 2500)) if long[at] != " ")
    for r in phrase_dedup.phrase_free(docs, 13, keep_text=False).collect():
        assert r.n_words == len(words[r.doc_id]) and r.n_removed == (whole if r.doc_id == 2 else 0)
    assert {r.doc_id: (r.keep_id, r.text_sha256) for r in exact_dedup.exact_groups(docs).collect()} == {d: (d, hashlib.sha256(t.encode()).hexdigest()) for d, t in texts}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_groups(docs, 4, 85).collect()} == {d: (len(set(zip(*(w[k:] for k in range(4)), strict=False))) or 1, d) for d, w in words.items()}
    file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ByteBpe(file, public_tokenizers.PATTERN).ranks, special_tokens={})
    for r in byte_bpe.encoded(docs, file, public_tokenizers.PATTERN, keep_ids=False).collect():
        t = dict(texts)[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, lib.encode_ordinary(t))).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    file = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=file)
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, file).collect()} == {d: len(lib.encode(t)) for d, t in texts}
    file = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(file)
    size = Counter()
    for r in packing.packed(docs, file).collect():
        size[r.doc_id] += r.length
    assert size == {d: len(lib.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts}


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_with_equal_sums_of_powers_differ(spark):
    """Words that a polynomial modulo 2**64 can't tell apart, alone and as bytes of a window."""
    for n in (1024, 2048, 4096):
        word = thue_morse(n)
        other = word.translate(str.maketrans("ab", "ba"))
        texts = [(i, " ".join(f"{w}{k}" if k != 5 else w for k in range(20)).replace(w, w)) for i, w in enumerate((word, other))]
        assert len(set(wordhash.words_of([word.encode(), other.encode()])[0].tolist())) == 2
        assert [r.n_removed for r in phrase_dedup.phrase_free(frame(spark, texts), 13).collect()] == [0, 0]
        assert {r.component_id for r in jaccard_join.near_groups(frame(spark, texts), 4, 85).collect()} == {0, 1}
        expected = brute_bytes(texts, 100)
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.substring_free(frame(spark, texts), 100).collect()} == expected


def test_word_hashes_do_not_depend_on_neighbours():
    rng = random.Random(8)
    words = list({"".join(rng.choice("abcé漢") for _ in range(rng.choice([1, 3, 7, 8, 9, 17, 255, 256, 257, 600]))) for _ in range(300)})
    alone = [int(wordhash.words_of([w.encode()])[0][0]) for w in words]
    assert wordhash.words_of([" \n ".join(words).encode()])[0].tolist() == alone and len(set(alone)) == len(words)
    stems = wordhash.words_of([" ".join(words).encode()], wordhash.GAP, 5)[0].tolist()
    assert stems == [int(wordhash.words_of([w.encode()[:5]])[0][0]) for w in words]


def test_rows_that_share_an_id_are_told_apart(spark):
    rng = random.Random(9)
    unique, shared, other = (" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(80)) for c in "usx")
    rows = [(9, shared), (9, unique), (None, other), (None, other + " tail"), (3, shared), (12, unique + " end")]
    cut = Counter((r.doc_id, r.n_words, r.n_removed) for r in phrase_dedup.phrase_free(frame(spark, rows), 13).collect())
    assert cut[(9, 80, 80)] == 1 and cut[(9, 80, 0)] == 1 and cut[(3, 80, 0)] == 1 and cut[(12, 81, 80)] == 1
    assert sum(n for (d, _, gone), n in cut.items() if d is None and gone == 80) == 1 and sum(cut.values()) == 6
    out = Counter((r.doc_id, r.kept_text in (unique, shared, other, other + " tail")) for r in suffix_dedup.substring_free(frame(spark, rows), 100).collect())
    assert out == {(9, True): 1, (9, False): 1, (None, True): 1, (None, False): 1, (3, True): 1, (12, False): 1}
    found = Counter((r.doc_id, r.component_id) for r in jaccard_join.near_groups(frame(spark, rows), 4, 85).collect())
    assert found == {(3, 3): 1, (9, 3): 1, (9, 9): 1, (12, 9): 1, (None, None): 2}


def test_windows_too_long_are_refused(spark):
    texts = messy(4, 20)
    for length in (320, 500):
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.substring_free(frame(spark, texts), length).collect()} == brute_bytes(texts, length)
    with pytest.raises(ValueError, match="501"):
        suffix_dedup.substring_free(frame(spark, texts), 501)


def test_packing_edges(spark):
    rows = spark.createDataFrame([(None, None, None, None, None), (1, "a", "en", "s", 1), (1, "a", "en", "s", 1)], SCHEMA)
    file = public_tokenizers.path("word_bpe_49k.json")
    clashing = rows.withColumns({n: F.lit("x") for n in ("start", "length", "sequence_id", "offset", "doc", "ids", "doc_tokens")})
    for own in (rows, clashing):
        out = packing.packed(own, file).collect()
        assert sorted((str(r.doc_id), r.start, r.length, r.doc_tokens) for r in out) == [("1", 0, 2, 2), ("1", 0, 2, 2), ("None", 0, 1, 1)]
        assert len({(r.sequence_id, r.offset) for r in out}) == 3
    assert packing.packed(spark.createDataFrame([], SCHEMA), file).count() == 0


def test_written_tables_go_to_the_shared_folder(spark):
    df = written(spark.range(3).toDF("x"))
    assert spark.sparkContext.getConf().get("spark.checkpoint.dir") in df.inputFiles()[0]
