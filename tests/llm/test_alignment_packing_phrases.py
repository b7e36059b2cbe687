"""Alignment, packing and phrases against brute force, with null, empty, long, tied and repeated rows and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tabwright.llm import align, collocations, packing, pieces

BYTE, PIECE = "byte_bpe_50k.json", "piece_bpe_32k.model"
SCHEMA = "doc_id long, text string, lang string, row string, part int, length string, pair int, n long"
_ALPHABET = ["a", "b", "é", "À", "×", " ", " ", "  ", "\n", "\n\n", "'", "'s", "'t", "’s", ",", ".", "!!", "1", "23", "\t", "\r\n",
             " ", "　", "“", "«", "中文", "я", "é", "👍", "<|endoftext|>", "<s>", "</s>", "▁", "_", "-", "the",
             "word", "\x1c", "\x00", "ﬁ", "'ll", "�", "\u0085"]


def path(name):
    import public_tokenizers
    return public_tokenizers.path(name)


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(9)
    return ["".join(rng.choices(_ALPHABET, k=rng.randint(0, 25))) for _ in range(4000)]


def test_ids_of_pieces_are_the_ids_of_whole_texts(odd_texts):
    import sentencepiece
    from tokenizers import Tokenizer
    tok, plain = Tokenizer.from_file(path(BYTE)), Tokenizer.from_file(path(BYTE))
    plain.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=path(PIECE))
    data = [t.encode() for t in odd_texts]
    some = [t for t in odd_texts if t]
    cases = [(pieces.Encoder(pieces.ByteBpe(path(BYTE)), 500), data,
              [e.ids for e in tok.encode_batch(odd_texts, add_special_tokens=False)]),
             (pieces.Encoder(pieces.ByteBpe(path(BYTE), True)), [b" " + d for d in data],
              [e.ids for e in plain.encode_batch([" " + t for t in odd_texts], add_special_tokens=False)]),
             (pieces.Encoder(pieces.PieceBpe(path(PIECE))), [b" " + t.encode() for t in some], sp.encode(some))]
    for encoder, texts, want in cases:
        assert encoder.model.cuttable
        for lo in range(0, len(texts), 700):
            ids, at = encoder.encode(texts[lo:lo + 700])
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want[lo:lo + 700]
    ids, at = cases[0][0].encode([])
    assert len(ids) == 0 and at.tolist() == [0]


def frame(spark, texts, lang=None):
    lang = lang or [None] * len(texts)
    rows = [(i if i != 4 else None, t, g, "r", 1, "x", 2, 3) for i, (t, g) in enumerate(zip(texts, lang))]
    return spark.createDataFrame(rows, SCHEMA)


# Alignment ------------------------------------------------------------------------------------
def brute_alignment(texts):
    al = align.Aligner(path(BYTE), path(PIECE))
    docs = []
    for t in texts:
        raw = (" " + t).encode() if t else b""
        a = al.a.tokenizer.encode(" " + t, add_special_tokens=False).ids if t else []
        b = al.b.processor.encode(t) if t else []
        if b"".join(al.bytes_a[i] for i in a) != raw or b"".join(al.bytes_b[i] for i in b) != raw:
            a, b = [], []
        ends_a = {int(e): k for k, e in enumerate(np.cumsum([len(al.bytes_a[i]) for i in a]))}
        ends_b = {int(e): k for k, e in enumerate(np.cumsum([len(al.bytes_b[i]) for i in b]))}
        cuts = sorted((ends_a[e], ends_b[e]) for e in ends_a.keys() & ends_b.keys())
        begin = [(-1, -1), *cuts]
        groups = [(a[x + 1:i + 1], b[y + 1:j + 1]) for (x, y), (i, j) in zip(begin, cuts)]
        docs.append((a, b, groups, [(a[i], b[j]) for i, j in cuts]))
    count = Counter(link for d in docs for link in d[3])
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for a, b, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(count[p] == best[p[1]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out, [d[2] for d in docs]


@pytest.fixture(scope="module")
def aligned_texts(odd_texts):
    rng = random.Random(3)
    words = ["river", "stone", "unbelievably", "the", "of", "Zürich", "naïve", "2024", "été"]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) + "." for _ in range(60)]
    return [None, "", "x", " lead", "same words here", "same words here", "the word " * 3000, "a" * 4000, "▁", "é" * 900,
            *prose, *odd_texts[:300]]


def test_alignment(spark, aligned_texts):
    want, groups = brute_alignment(aligned_texts)
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    docs = frame(spark, aligned_texts).repartition(3)
    for head in (align.HEAD_PAIRS, 40, 0):                # all pairs, some and none in every worker
        got = align.align(docs, path(BYTE), path(PIECE), head_pairs=head).collect()
        keyed = sorted(((r.doc_id, *(r[c] for c in columns)) for r in got), key=str)
        assert keyed == sorted(((i if i != 4 else None, *w) for i, w in enumerate(want)), key=str)
    rows = align.groups(docs, path(BYTE), path(PIECE)).select("row.doc_id", "row.n", "groups").collect()
    found = {r.doc_id: [(list(g.a), list(g.b)) for g in r.groups] for r in rows}
    assert all(r.n == 3 for r in rows)
    assert found == {i if i != 4 else None: g for i, g in enumerate(groups)}
    empty = docs.limit(0)
    assert align.align(empty, path(BYTE), path(PIECE)).count() == 0
    assert align.groups(empty, path(BYTE), path(PIECE)).count() == 0


def test_lockstep_with_and_without_lanes():
    rng = np.random.default_rng(4)
    ends, bounds = ([], []), ([0], [0])
    base = 0
    for n in (0, 5, 4000, 1, 900):
        for side in (0, 1):
            inner = np.sort(rng.choice(np.arange(1, 3 * n), n - 1, replace=False)) if n > 1 else np.zeros(0, int)
            own = np.append(inner, 3 * n)[:n] + base
            ends[side].append(own)
            bounds[side].append(bounds[side][-1] + len(own))
        base += 3 * n
    a, b = (np.concatenate(e).astype(np.int64) for e in ends)
    i, j = align.lockstep(a, b, *(np.array(x) for x in bounds))
    meet = np.intersect1d(a, b)
    assert a[i].tolist() == b[j].tolist() == meet.tolist()


# Packing --------------------------------------------------------------------------------------
def best_fit_decreasing(lengths, capacity):
    gaps, n = [0] * (capacity + 1), 0
    for size in sorted(lengths, reverse=True):
        gap = next((g for g in range(size, capacity + 1) if gaps[g]), None)
        if gap is None:
            n, gap = n + 1, capacity
        else:
            gaps[gap] -= 1
        gaps[gap - size] += 1
    return n


@pytest.mark.parametrize("make", [
    lambda r: r.randint(1, 64), lambda r: r.randint(1, 5), lambda r: r.randint(25, 44), lambda r: 33, lambda r: 64,
    lambda r: r.choice([10, 20, 54]), lambda r: min(64, int(r.lognormvariate(2, 1)) + 1)])
def test_plan_uses_every_piece_once_and_is_as_short_as_best_fit(make):
    rng = random.Random(8)
    for n in (1, 40, 3000):
        lengths = [make(rng) for _ in range(n)]
        steps = packing.plan(Counter(lengths), 64)
        used = Counter()
        for s in steps:
            assert sum(x * k for x, k in s.runs) <= 64
            for x, k in s.runs:
                used[x] += k * s.times
        assert used == Counter(lengths)
        assert sum(s.times for s in steps) <= best_fit_decreasing(lengths, 64)
        assert len(steps) <= 4 * len(used) + 4


@pytest.mark.parametrize("capacity", [32, 1024])
def test_packing(spark, capacity):
    from tokenizers import Tokenizer
    rng = random.Random(5)
    tok = Tokenizer.from_file(path(BYTE))
    words = ["river", "stone", "unbelievably", "the", "of", "Zürich"]
    texts = [None, "", "one", "same words here", "same words here", "the " * 31, "the " * 32, "x y " * 4000,
             *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(150))]
    got = packing.pack(frame(spark, texts).repartition(4), path(BYTE), capacity=capacity).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        rows = sorted(by_doc[i if i != 4 else None], key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(-(-len(ids) // capacity)))
        assert [r.length for r in rows[1:]] == [capacity] * (len(rows) - 1)
        at = 0
        for r in rows:
            part = np.array(ids[at:at + r.length], "<u4").tobytes()
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(part))
            at += r.length
        assert at == len(ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by_sequence) <= best_fit_decreasing([r.length for r in got], capacity)
    assert packing.pack(frame(spark, []), path(BYTE)).collect() == []


# Phrases --------------------------------------------------------------------------------------
def brute_phrases(rows, top, least):
    out = []
    words, count = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for n in range(1, 5):
                count[lang].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    for lang, f in count.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = set()
        for p, a in candidates.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    if 100 * a >= 80 * candidates[p[i:i + n]]:
                        dropped.add(p[i:i + n])
        scored = []
        for p, a in candidates.items():
            if p not in dropped:
                s, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def phrase_rows():
    rng = random.Random(12)
    words = [f"w{i}" for i in range(60)] + ["Été", "x_y", "don't", "A", "B C"]
    weights = [1 / (i + 2) for i in range(len(words))]
    phrases = ["red herring", "as well as", "on the other hand", "by and large of", "new new new new", "odd pair"]
    rows = [(None, "en"), ("", "fr"), (" \t ", None), (".,;", "en")]
    for i in range(500):
        out = []
        for _ in range(rng.randint(1, 60)):
            out.append(rng.choice(phrases) if rng.random() < 0.15 else rng.choices(words, weights)[0])
            out.append(rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b"]))
        rows.append(("".join(out), rng.choice(["en", "en", "en", "fr", None, "und", ""])))
    return rows + [rows[10]] * 40 + [("lone pair " * 3000, "de")]


@pytest.mark.parametrize("top, least", [(2000, 5), (12, 5), (3, 5), (1, 3), (5, 10 ** 9)])
def test_phrases(spark, phrase_rows, top, least):
    docs = frame(spark, *map(list, zip(*phrase_rows))).repartition(5)
    got = sorted(tuple(r) for r in collocations.collocations(docs, top=top, min_count=least).collect())
    assert got == brute_phrases(phrase_rows, top, least)


def test_thresholds_fall_until_settled(spark, phrase_rows, monkeypatch):
    docs = frame(spark, *map(list, zip(*phrase_rows))).repartition(2)
    seen = []
    plain = collocations._thresholds
    monkeypatch.setattr(collocations, "FIRST_SHARE", 1)
    monkeypatch.setattr(collocations, "WIDER", 2)
    monkeypatch.setattr(collocations, "_thresholds", lambda g, n: seen.append(plain(g, n)) or seen[-1])
    got = sorted(tuple(r) for r in collocations.collocations(docs, top=20, min_count=5).collect())
    assert got == brute_phrases(phrase_rows, 20, 5)
    assert len(seen) > 1 and any(t > 0 for t in seen[0].values())


def test_phrases_of_an_empty_table(spark):
    rows = collocations.collocations(frame(spark, []))
    assert rows.collect() == [] and rows.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
