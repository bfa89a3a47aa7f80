from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np

from postmill.llm.automata import DEPTH, Automaton
from postmill.llm.collocations import COLLOCATIONS_SQL, Windows, _rows, mine_collocations, op11_collocations, range_cuts

SF = "/root/testdata/sf0.001"


def brute(rows, least, share=80, top=2000):
    """The contract, read plainly: (lang, text) rows to result rows."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for i in range(len(words)) for k in range(1, min(4, len(words) - i) + 1))
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    longest = Counter()
    for (lang, w), a in cand.items():
        for sub in {w[i : i + k] for k in range(2, len(w)) for i in range(len(w) - k + 1)}:
            longest[lang, sub] = max(longest[lang, sub], a)
    out = []
    for (lang, w), a in cand.items():
        if 100 * longest[lang, w] >= share * a:
            continue
        score, _, le, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, le, r, n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks = Counter()
    result = []
    for row in out:
        ranks[row[0]] += 1
        if ranks[row[0]] <= top:
            result.append((row[0], ranks[row[0]], *row[1:]))
    return sorted(result)


def got(df):
    return sorted(map(tuple, df.collect()))


def test_query_equals_brute_force_and_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.lang, r.text) for r in docs.collect()], 30)
    assert want and got(op11_collocations(spark, SF)) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(con.execute(COLLOCATIONS_SQL).fetchall()) == want


def test_small_chunks_and_ranges_change_nothing(spark):
    rng = random.Random(3)
    vocabulary = ["a", "b", "c", "É", "é", "A-b", "\xa0", "\x85x", "語", "\U0001f600", "<|x|>"]
    texts = [(rng.choice(["en", "de", None, ""]), "".join(rng.choice(vocabulary) + rng.choice(["  ", " ", " ", " ", "\t", ".", ", ", "\n", "\x0b"]) for _ in range(rng.randrange(60)))) for _ in range(150)]
    texts += [("en", "x y z w " * 4000), ("en", None), (None, ""), ("en", "..,;"), ("fr", "one"), ("big", "hot pair " * 9000)]
    docs = spark.createDataFrame([(i, t, la, 1) for i, (la, t) in enumerate(texts)], "doc_id long, text string, lang string, range int").repartition(6)
    want = brute(texts, 5)
    assert len(want) > 50 and any("\xa0" in r[2] for r in want)
    assert got(mine_collocations(docs, least=5)) == want
    cuts = range_cuts(_rows(docs), 100)
    assert sum(map(len, cuts.values())) > 5
    assert got(mine_collocations(docs, least=5, chunk=300, size=100)) == want
    assert got(mine_collocations(docs, least=5, top=3)) == brute(texts, 5, top=3)
    assert mine_collocations(docs.limit(0)).count() == 0


def test_windows_taken_in_the_middle_of_a_text(monkeypatch):
    from postmill.llm import collocations

    text = " ".join(random.Random(1).choice(["a", "bb", "c.", "d"]) for _ in range(3000))
    whole = Windows()
    list(whole.add(text.encode()))

    def counted(taken):
        words, windows = taken
        return Counter(tuple(words[i] for i in w) for w in windows.T)

    want = counted(whole.take(True))
    monkeypatch.setattr(collocations, "STRETCH", 50)
    own, found = Windows(), Counter()
    for _ in own.add(text.encode()):
        found += counted(own.take(False))
    assert found + counted(own.take(True)) == want


def test_automata():
    rng = random.Random(2)
    words = [b"", *sorted({bytes([rng.randrange(97, 123)]) * rng.randrange(1, 3) for _ in range(12)})]

    def some(n):
        return np.array([[rng.randrange(1, len(words)), *([0] * (3 - k)), *[0] * k] if (k := rng.randrange(3)) == 2 else [rng.randrange(1, len(words)) for _ in range(4)] for _ in range(n)], np.uint32).T

    def table(a):
        return {tuple(a.words[i] for i in p): w for p, w in zip(a.paths().T.tolist(), a.weights.tolist())}

    sets = [some(n) for n in (1, 40, 300)]
    parts = [Automaton.of(words, s) for s in sets]
    for s, a in zip(sets, parts):
        want = Counter(tuple(words[i] for i in p) for p in s.T.tolist())
        assert table(a) == want == table(Automaton.unpack(*a.pack()))
        for d in range(DEPTH):
            prefixes = Counter()
            for p, w in want.items():
                prefixes[p[: d + 1]] += w
            assert sorted(prefixes.items()) == [(tuple(a.words[i] for i in a.paths()[: d + 1, f]), w) for f, w in zip(a.firsts[d], a.state_weights(d).tolist())]
    whole = Automaton.union(parts)
    assert table(whole) == sum((Counter(table(p)) for p in parts), Counter())
    cuts = sorted({tuple(rng.choice(words[1:] + [b"zz", b"q~"]) for _ in range(rng.randrange(1, 4))) + (b"",) for _ in range(7)})
    seen = {}
    for number, part in whole.ranges([c + (b"",) * (4 - len(c)) for c in cuts]):
        for p, w in table(part).items():
            assert sum(c <= p for c in cuts) == number
            seen[p] = w
    assert seen == table(whole)
    asked = Automaton.of(words + [b"~~"], np.concatenate([some(200), np.full((4, 1), len(words), np.uint32)], axis=1))
    known = table(whole)
    assert whole.compose(asked).tolist() == [known.get(p, 0) for p in table(asked)]
    empty = Automaton.of([b""], np.zeros((4, 0), np.uint32))
    assert empty.compose(asked).tolist() == [0] * len(asked.weights) and not table(Automaton.unpack(*empty.pack()))
