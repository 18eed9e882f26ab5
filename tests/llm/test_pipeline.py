"""Stages of the pipeline against brute force, and its edge cases."""

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lectern.llm.common import documents, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_duplicates", "substring_dedup", "packing"]
    docs, kept = documents(spark, sf_dir), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        kept.append({r.doc_id: r for r in docs.collect()})
        assert docs.columns == COLUMNS and len(kept[-1]) == docs.count()
    toxic, exact, near, cut = kept
    last = {}
    for d in sorted(toxic):
        last[toxic[d].text] = d
    assert set(exact) == set(last.values())

    def shingles(t):
        w = WORD.findall(t.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    sets, root = {d: shingles(r.text) for d, r in exact.items()}, {d: d for d in exact}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(near) == {d for d in root if find(d) == d}
    assert set(cut) == set(near) and all(len(cut[d].text) <= len(near[d].text) and cut[d].n_chars == len(cut[d].text) for d in cut)
    first = {}
    for d in sorted(near):
        raw = near[d].text.encode()
        for i in range(len(raw) - 99):
            first.setdefault(raw[i : i + 100], (d, i))
    lost = 0
    for d in near:
        raw = near[d].text.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if first[raw[i : i + 100]] != (d, i):
                gone[i : i + 100] = b"\1" * 100
        left, at = [], 0
        for c in near[d].text:
            n = len(c.encode())
            left.append("" if any(gone[at : at + n]) else c)
            at += n
        assert cut[d].text == "".join(left)
        lost += sum(gone)
    assert lost > 0
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, used = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.packing(spark, docs, sf_dir).collect():
        pieces[r.doc_id].append(r)
        used[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(cut)
    for d, own in pieces.items():
        ids, at = [*lib.encode(cut[d].text, add_special_tokens=False).ids, 2], 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= corpus_pipeline.SEQUENCE


def test_stages_take_odd_rows(spark, sf_dir):
    rows = [(None, None, None, None, None), (None, "same text", "en", "s", 9), (1, "same text", "en", "s", 9), (1, "same text", "en", "s", 9), (2, "", None, None, 0), (3, "long " * 300, "en", "s", 5), (4, "long " * 300 + "tail", "en", "s", 5)]
    for name, stage in corpus_pipeline.STAGES:
        for own in (rows, []):
            out = stage(spark, spark.createDataFrame(own, SCHEMA), sf_dir)
            assert (out.count() > 0) == bool(own), name
            if name != "packing":
                assert out.columns == COLUMNS
    kept = corpus_pipeline.exact_dedup(spark, spark.createDataFrame(rows, SCHEMA), sf_dir)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [1, 2, 3, 4]


def test_stages_take_clashing_columns(spark, sf_dir):
    """Columns named as those the stages use inside pass as they are; of rows that share a doc_id the right one goes."""
    names = ["own_hash", "stay_id", "doc", "key", "carried", "component", "kept", "text_sha256", "ranges", "score", "toxic", "n"]
    schema = SCHEMA + "".join(f", {n} string" for n in names)
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(3, a), (5, a), (5, b), (7, b + " more"), (8, None), (9, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), *[f"{n}{i}" for n in names]) for i, (d, t) in enumerate(rows)], schema)
    expected = {"toxicity": [0, 1, 2, 3, 4, 5], "exact_dedup": [1, 2, 3, 5], "near_duplicates": [0, 2, 4, 5], "substring_dedup": [0, 1, 2, 3, 4, 5]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert sorted(int(r.own_hash[8:]) for r in kept) == expected[name], name
        for r in kept:
            i = int(r.own_hash[8:])
            assert all(r[n] == f"{n}{i}" for n in names) and r.doc_id == rows[i][0]
    assert corpus_pipeline.packing(spark, docs, sf_dir).count() >= 6
