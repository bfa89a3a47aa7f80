from __future__ import annotations

import hashlib
import random
import re

import duckdb

from postmill.llm.middle import FILL_IN_MIDDLE_SQL, Frames, digests, fill_in_middle, frame_documents, op13_fill_in_middle, restored

SF = "/root/testdata/sf0.001"


def plain(doc_id, text, rate=100, spm=50):
    """The contract, read plainly over the whole text."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    key = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(key[i : i + 8], 16) for i in range(0, 32, 8))
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    form = "plain" if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate else "spm" if h4 % 100 < spm else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sizes = (None, None) if form == "plain" else (len(p), len(m))
    return doc_id, n, form, *sizes, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def order(rows):
    return sorted(map(tuple, rows), key=str)


def test_query_follows_the_contract_and_its_sql(spark):
    got = order(op13_fill_in_middle(spark, SF).collect())
    texts = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert got == order(plain(r.doc_id, r.text) for r in texts)
    assert len({r[2] for r in got}) >= 2
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == order(con.execute(FILL_IN_MIDDLE_SQL).fetchall())


def test_odd_rows(spark):
    rng = random.Random(5)
    texts = [None, "", "\n", "\n\n\n", "one line", "ends\n", "<P>", "a <S> b\nc", "<", "<P\n>\n<S\n>", "é\n" * 40, "\U0001f600 x\r\ny z\n", "\x00\n\x01", "long " * 300_000 + "\n" + "ü" * 200_001 + "\nend"]
    texts += ["".join(rng.choice("aé\n<PSM>\U0001f600 ") for _ in range(rng.randrange(400))) for _ in range(120)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(4, "one line", "y", 2), (4, "one line", "y", 2), (None, "no\nid\n", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, form int")
    for size in (16, 1 << 15):
        framed = frame_documents(docs, size)
        assert order(digests(fill_in_middle(framed)).collect()) == order(plain(i, t) for i, t, _, _ in rows)
    some = fill_in_middle(frame_documents(docs), rate=40, spm=10)
    assert order(digests(some).collect()) == order(plain(i, t, 40, 10) for i, t, _, _ in rows)
    assert digests(fill_in_middle(frame_documents(docs.limit(0)))).count() == 0


def test_frames_are_independent_and_seekable():
    rng = random.Random(6)
    for _ in range(60):
        text = "".join(rng.choice(["a", "é", "\n", "語", "\U0001f600"]) for _ in range(rng.randrange(1, 300)))
        data, units = text.encode(), re.findall(r"[^\n]*\n|[^\n]+", text)
        cuts = sorted(rng.randrange(len(data) + 1) for _ in range(3))
        frames = Frames.of([data[: cuts[0]], data[cuts[0] : cuts[1]], data[cuts[1] :]], rng.choice([5, 17, 64]))
        assert frames.units[-1] == len(units) and frames.chars[-1] == len(text) and b"".join(frames.stream()) == data
        assert "".join(frames.frame(i).decode() for i in reversed(range(len(frames.ends))))  # each alone, in any order
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert frames.cut(k) == (len(head.encode()), len(head))
        assert b"".join(frames.stream(cuts[0], cuts[2])) == data[cuts[0] : cuts[2]]
        assert frames.find(data[-2:]) == data.find(data[-2:])


def test_restoring_finds_markers_across_frames():
    for form, out in (("psm", b"<P><<S>s<<M>m<"), ("spm", b"<S>s<<P><<M>m<")):
        for size in (4, 5, 7, 100):
            assert b"".join(restored(Frames.of([out], size), form)) == b"<m<s<"
