import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from helpers import documents, prose
from tessera.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces(spark):
    texts = [None, "", "word", prose(3000, 1), *[prose(1 + (i * 37) % 900, i) for i in range(120)]]
    docs = documents(spark, list(enumerate(texts))).repartition(3)
    t = Tokenizer.from_file(PATH)
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in enumerate(texts)}
    for block in (P.BLOCK_IDS, 5000):
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for r in P.pack(docs, PATH, block_ids=block).collect():
            ids = want[r["doc_id"]]
            assert r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
            by_doc[r["doc_id"]].append((r["start"], r["length"]))
            by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        for i, ids in want.items():
            at = 0
            for start, n in sorted(by_doc[i]):
                assert start == at and n > 0
                at += n
            assert at == len(ids)
        for parts in by_sequence.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= P.WINDOW
        used = sum(map(len, want.values()))
        assert len(by_sequence) * P.WINDOW - used < (3 if block == P.BLOCK_IDS else used // 5000 + 4) * P.WINDOW


def test_tightest_window():
    r = random.Random(5)
    tree, rooms = P.OpenWindows(50), {}
    for i in range(400):
        if r.random() < 0.6:
            rooms[i] = r.randint(1, 50)
            tree.add(i, rooms[i])
        else:
            need = r.randint(1, 50)
            fit = [v for v in rooms.values() if v >= need]
            got = tree.take(need)
            assert (got[1] if got else None) == (min(fit) if fit else None)
            if got:
                assert rooms.pop(got[0]) == got[1]


def test_encoder_equals_tokenizers():
    e, t, r = P.Encoder(PATH), Tokenizer.from_file(PATH), random.Random(3)
    assert e.fast
    pool = ["a", "B", "é", "中", "1", "²", " ", "  ", "\n", "\t", "'s", "!", "😀", "\x1c", "\x85", "\xa0", " ", "\x00", "<|endoftext|>", "नि", "don't", "\x0b"]
    for _ in range(3000):
        text = "".join(r.choice(pool) for _ in range(r.randint(0, 14)))
        assert np.frombuffer(e.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_long_runs():
    """Texts of one kind of character, however long, get tokenizers' ids."""
    e, t = P.Encoder(PATH), Tokenizer.from_file(PATH)
    for text in ("a" + " " * 499 + "b", "a" + " " * 500 + "b", "a" + " " * 2_000_000, " " * 2_000_000 + "b", "\n" * 2_000_000, "\t \n" * 500_000, "x" * 2_000_000, "7" * 2_000_000):
        assert e.encode(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
