"""Scores against a plain count of words and a sum over every cut of a word."""

import math
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assay.llm import lattice_lm
from assay.llm.lattice_lm import Pieces, op8_lattice_lm, score

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


class Brute:
    def __init__(self, rows):
        self.library = Tokenizer.from_file(PATH)
        self.train = [self.is_train(d) for d, _ in rows]
        self.count = Counter(w for (d, t), y in zip(rows, self.train) if y for w in words_of(t))
        self.ends = sum(self.train)
        self.n, self.v = sum(self.count.values()) + self.ends, len(self.count) + (self.ends > 0)
        byte = lattice_lm._bytes_of()
        self.go, self.stop = {}, {}
        for piece, _ in self.library.get_vocab(with_added_tokens=False).items():
            ends = piece.endswith("</w>")
            s = bytes(byte[c] for c in piece.removesuffix("</w>"))
            (self.stop if ends else self.go)[s] = 0
        back = {i: p for p, i in self.library.get_vocab(with_added_tokens=False).items()}
        for w, c in self.count.items():
            ids = [i for i in self.library.encode(w, add_special_tokens=False).ids if i in back]
            for k, i in enumerate(ids):
                s, last = bytes(byte[x] for x in back[i].removesuffix("</w>")), k == len(ids) - 1
                if last:
                    (self.stop if back[i].endswith("</w>") else self.go)[s] += c
                elif s in self.go:
                    self.go[s] += c
                else:
                    for b in s:
                        self.go[bytes([b])] += c
        for _ in range(lattice_lm.ITERATIONS):
            self.expect()
        self.total = sum(self.go.values()) + sum(self.stop.values()) + len(self.go) + len(self.stop)
        self.held: dict[str, float] = {}

    def expect(self):
        """Expected counts of all pieces over every cut of every training word."""
        total = sum(self.go.values()) + sum(self.stop.values()) + len(self.go) + len(self.stop)
        go, stop = dict.fromkeys(self.go, 0.0), dict.fromkeys(self.stop, 0.0)
        for w, c in self.count.items():
            b = w.encode()
            cuts = [(j, i) for i in range(1, len(b) + 1) for j in range(max(0, i - 40), i) if b[j:i] in (self.stop if i == len(b) else self.go)]
            p = {(j, i): ((self.stop if i == len(b) else self.go)[b[j:i]] + 1) / total for j, i in cuts}
            f, g = [1.0] + [0.0] * len(b), [0.0] * len(b) + [1.0]
            for j, i in cuts:
                f[i] += f[j] * p[j, i]
            for j, i in sorted(cuts, reverse=True):
                g[j] += p[j, i] * g[i]
            for j, i in cuts:
                (stop if i == len(b) else go)[b[j:i]] += c * f[j] * p[j, i] * g[i] / f[-1]
        self.go, self.stop = go, stop

    @staticmethod
    def is_train(d):
        return zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2

    def word(self, w):
        if w not in self.held:
            b = w.encode()
            f = [1.0] + [0.0] * len(b)
            for i in range(1, len(b) + 1):
                table = self.stop if i == len(b) else self.go
                f[i] = sum(f[j] * (table[b[j:i]] + 1) / self.total for j in range(max(0, i - 40), i) if b[j:i] in table)
            self.held[w] = math.log10(f[-1])
        return self.held[w]

    def row(self, d, t):
        ws = words_of(t)
        each = math.log10(self.n + self.v + 1)
        base = sum(math.log10(self.count[w] + 1) - each for w in ws) + math.log10(self.ends + 1) - each
        end = (self.ends + 1) / (self.n + 2)
        return (d, not self.is_train(d), len(ws) + 1, sum(self.count[w] > 0 for w in ws) + (self.ends > 0), self.n, base, sum(self.word(w) + math.log10(1 - end) for w in ws) + math.log10(end))


def same(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted((tuple(r) for r in got), key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("broadcast", [1 << 18, 50, 0])
def test_whole_table(spark, monkeypatch, broadcast):
    monkeypatch.setattr(lattice_lm, "BROADCAST_WORDS", broadcast)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    brute = Brute(rows)
    same(op8_lattice_lm(spark, SF).collect(), [brute.row(*r) for r in rows])


def test_odd_rows(spark):
    rows = [(None, "A null id"), (1, None), (2, ""), (2, "x\x0by Z!"), (2, "x\x0by Z!"), (3, "é" * 20 + " \U0001f600 a\xa0b"), (4, "The the THE"), (10, "<|endoftext|> it's"), (19, "unseen-word")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, train string")
    brute = Brute(rows)
    same(score(df, PATH).collect(), [brute.row(*r) for r in rows])
    assert score(df.limit(0), PATH).collect() == []


def test_long_word_and_sum_of_probabilities():
    import numpy as np

    p = Pieces(PATH)
    logs = p.log_probabilities(np.zeros(p.size))
    data = np.frombuffer(("ab" * 2000).encode(), np.uint8)
    assert p.log_likelihood(data, np.array([0, len(data)]), logs)[0] < -1000
    # Over all words of one byte the probabilities sum to the share of pieces that end one at once.
    one = np.arange(256, dtype=np.uint8)
    assert np.exp(p.log_likelihood(one, np.arange(257), logs)).sum() == pytest.approx(256 / p.known)


def test_model_beats_chance_on_held_out_documents(spark):
    """Held out documents are likelier than their letters shuffled."""
    import random

    r = random.Random(3)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) between 50 and 2000").collect()
    shuffled = [(d + 10**6, "".join(r.sample(t, len(t)))) for d, t in docs if not Brute.is_train(d) and not Brute.is_train(d + 10**6)]
    rows = [tuple(x) for x in docs] + shuffled
    got = {x["doc_id"]: x["score"] for x in score(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()}
    assert shuffled and all(got[d - 10**6] > got[d] for d, _ in shuffled)
