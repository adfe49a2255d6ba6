import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lattica.llm import packing
from lattica.llm.bpe import WordEncoder
from lattica.llm.token_counts import count_texts, safe_pieces, token_counts
from lattica.llm.words import text_bytes

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_library(spark, docs, odd, library):
    for d in (docs, odd):
        text = [r.text for r in d.select("text").collect()]
        got = token_counts(d).collect()
        assert [r.n_tokens for r in got] == [len(ids_of(library, t)) for t in text]
        assert [r.n_bytes for r in got] == [len((t or "").encode()) for t in text]
        assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert token_counts(docs.limit(0)).count() == 0


def test_hard_texts(library):
    texts = ["<|startoftext|> a<|endoftext|>b", "it's I'll don't", "ÉCOLE! Straße?? naïve,", "é ́x ÅB", "a b c\x1cd", "x" * 5000, "İstanbul ΣΑΣ", "12,345.67 $9", "the\x0bthe\x0cthe", "¡hola! «quoi»"]
    assert count_texts(pa.array(texts), PATH)[1].tolist() == [len(ids_of(library, t)) for t in texts]


def test_cuts_are_safe(library):
    text = "Words, and more words! " * 300 + "x" * 500
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    cuts = list(safe_pieces(data, 0, len(data), 100))
    assert [a for a, _ in cuts] == [0, *(b for _, b in cuts[:-1])] and cuts[-1][1] == len(data)
    assert all(text[b].isspace() for _, b in cuts[:-1])
    assert count_texts(pa.array([text, None, text]), PATH, group_bytes=100)[1].tolist() == [len(ids_of(library, text)), 0, len(ids_of(library, text))]


def test_store_is_bounded(library):
    texts = [" ".join(f"word{chr(97 + k % 26)}{chr(97 + j % 26)}x{j}" for j in range(200)) for k in range(30)]
    enc = WordEncoder(PATH, entries=100, opaque_bytes=500)
    for t in texts:
        counts, ids = enc.encode(*text_bytes(pa.array([t])))
        assert ids.tolist() == ids_of(library, t) and counts[0] == len(ids)
    assert enc.known.used <= 400 and enc.kept <= 4000


def unpacked(bins):
    c = Counter()
    for p, n in bins.items():
        assert sum(p) <= 4096
        for x in p:
            c[x] += n
    return c


def test_search_packs_everything_and_never_needs_more_bins():
    rng = np.random.default_rng(0)
    for size in (1, 50, 3000):
        for low, high in ((1, 4097), (1300, 2200), (4096, 4097), (1, 20)):
            h = Counter(rng.integers(low, high, size).tolist())
            first = packing.best_fit(h, 4096)
            better = packing.local_search(first, 4096, steps=300)
            assert unpacked(first) == unpacked(better) == h
            assert -(-sum(x * n for x, n in h.items()) // 4096) <= sum(better.values()) <= sum(first.values())
    assert packing.pack_lengths({}) == Counter()


def test_search_empties_a_bin():
    stuck = Counter({(6, 3): 1, (5, 2): 1, (4,): 1})  # limit 10: the three bins hold 20
    assert sum(packing.local_search(stuck, 10).values()) == 2


def gains(a, b, limit):
    """What each move from b to a, or exchange of one of a for one or two of b, adds to a."""
    out = [y for y in b]
    for x in a:
        out += [y - x for y in b] + [b[i] + b[j] - x for i in range(len(b)) for j in range(i)]
    return [d for d in out if 0 < d <= limit - sum(a)]


def test_search_leaves_no_step():
    """No gain of d by a pattern that raises the sum of squared fills: d more than the giver is fuller."""
    for seed in range(6):
        h = Counter(np.random.default_rng(seed).integers(12, 60, 150).tolist())
        bins = packing.local_search(packing.best_fit(h, 100), 100)
        if sum(bins.values()) > -(-sum(x * n for x, n in h.items()) // 100):
            for a in bins:
                for b in bins:
                    if a != b or bins[a] > 1:
                        assert not any(d > sum(b) - sum(a) for d in gains(a, b, 100))


def test_search_covers_many_patterns():
    h = Counter(np.random.default_rng(0).integers(1300, 2200, 3000).tolist())
    first = packing.best_fit(h, 4096)
    assert sum(1 for p in first if sum(p) < 4096) > 256
    better = packing.pack_lengths(h)
    assert unpacked(better) == h
    assert sum(better.values()) < sum(first.values())


def check_pieces(rows, text_of, library):
    end = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == end.get(r.sequence_id, 0)
        end[r.sequence_id] = r.offset + r.length
    assert not end or max(end.values()) <= 4096
    total = Counter()
    for r in rows:
        ids = ids_of(library, text_of(r)) + [1]
        part = ids[r.start : r.start + r.length]
        assert r.start == 4096 * r.piece
        assert zlib.crc32(np.array(part, dtype="<u4").tobytes()) == r.ids_crc32
        total[r.doc_id] += len(part)
    return total


def test_packing(spark, docs, odd, library):
    texts = {r.doc_id: r.text for r in docs.collect()}
    total = check_pieces(packing.pack_documents(docs).collect(), lambda r: texts[r.doc_id], library)
    assert total == {k: len(ids_of(library, t)) + 1 for k, t in texts.items()}
    texts = {r.doc_id: r.text for r in odd.collect()}
    rows = packing.pack_documents(odd).collect()
    check_pieces(rows, lambda r: texts[r.doc_id], library)
    assert sum(r.length for r in rows) == sum(len(ids_of(library, r.text)) + 1 for r in odd.collect())
    assert packing.pack_documents(docs.limit(0)).count() == 0
