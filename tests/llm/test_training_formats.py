"""Fill-in-middle, periodic runs and chat formatting against plain versions, and exactly back."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm.awkward import AWKWARD
from pyspark.sql import functions as F
from tessera.llm import chat, infill, periods
from tessera.llm.queries import BYTES, QUERIES

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
MORE = [(20, "a\nb\nc\n", "a"), (21, "\n\n\n", "a"), (22, "no end", "a"), (23, "has <S> in it\nnext", "a"), (24, "<P", "a"), (25, "one\r\ntwo\r\n", "a"), (26, "é\n\U0001f600\n", "a"), (27, "<\n<\nP>\nS>\n<", "a")] + [(i, "line one\nline two\nline three\nlast", "b") for i in range(100, 140)]


# --- fill in the middle


def plain_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text):
        return doc_id, len(units), "plain", None, None, text
    return doc_id, len(units), *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))


def test_infill_against_the_definition(make):
    rows = AWKWARD + MORE
    out = infill.transform(make(rows)).withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    assert collections.Counter(tuple(r)[:6] for r in out) == collections.Counter(plain_infill(d, t) for d, t, _ in rows)
    assert collections.Counter((r.doc_id, r.back) for r in out) == collections.Counter((d, t or "") for d, t, _ in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert infill.transform(make([])).count() == 0


def test_infill_general_interface(make):
    """Other units, sentinels, rates and seeds; the text comes back from the output."""
    marks = ("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")
    rows = AWKWARD + MORE
    for seed, rate, spm in ((1, 100, 0), (1, 100, 100), (2, 40, 50), (3, 0, 50)):
        out = infill.transform(make(rows), seed=seed, rate=rate, spm_rate=spm, separator=" ", sentinels=marks).withColumn("back", infill.restore(F.col("output"), F.col("form"), marks)).collect()
        assert collections.Counter((r.doc_id, r.back) for r in out) == collections.Counter((d, t or "") for d, t, _ in rows)
        forms = {r.form for r in out}
        assert forms <= {"plain", *(("spm",) if spm == 100 else ("psm",) if spm == 0 else ("psm", "spm"))} and (rate > 0) == (len(forms) > 1)
        assert all(r.n == len(re.findall("[^ ]* |[^ ]+", t)) for r in out for t in [r.back])


def test_infill_slices_hold_few_bytes(monkeypatch):
    monkeypatch.setattr(infill, "SLICE", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(["aaaa", "bbbb", "c" * 50, "", "dd", "e" * 10, None])], names=["text"])
    parts = [p.column(0).to_pylist() for p in infill._slices(batch, "text")]
    assert [x for p in parts for x in p] == batch.column(0).to_pylist() and all(len(p) == 1 or sum(len(x or "") for x in p) <= 10 for p in parts)


# --- periodic runs


def plain_runs(words, exponent=4, shortest=6):
    """Every stretch of every period, by the definition."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        at = q
        while at < n:
            end = at
            while end < n and words[end] == words[end - q]:
                end += 1
            if end - at + q >= max(shortest, exponent * q):
                found.setdefault((at - q, end), q)
            at = max(end, at + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def word_lists(seed, n=150):
    rng = random.Random(seed)
    for _ in range(n):
        kind, size = rng.randrange(5), rng.randint(0, 250)
        if kind == 0:
            words = [rng.randint(0, rng.choice([0, 1, 2])) for _ in range(size)]
        elif kind == 1:
            words = [x for _ in range(rng.randint(1, 12)) for x in [rng.randint(0, 3) for _ in range(rng.randint(1, 20))] * rng.randint(1, 9)]
        elif kind == 2:  # runs of runs
            words = (([rng.randint(0, 1) for _ in range(rng.randint(1, 6))] * rng.randint(1, 8) + [2]) * rng.randint(1, 9))[:400]
        elif kind == 3:
            a, words = [0], [0, 1]
            while len(words) < size:
                a, words = words, words + a
        else:
            words = [rng.randint(0, 1000) for _ in range(size)] + [7] * rng.randint(0, 40)
        yield words


@pytest.mark.parametrize("exponent,shortest", [(4, 6), (2, 2), (3, 10), (6, 6)])
def test_catcher_against_the_definition(exponent, shortest):
    rng = random.Random(exponent)
    for words in word_lists(exponent):
        want = plain_runs(words, exponent, shortest)
        for piece in (1, 7, 64, 10**6):
            catcher, at = periods.SquareCatcher(exponent, shortest, rng.choice([None, len(words)])), 0
            while at < len(words):
                catcher.append(np.array(words[at : at + piece], np.int64))
                at += piece
            assert catcher.runs() == want


def test_catcher_knows_the_runs_so_far():
    catcher = periods.SquareCatcher()
    words = [1, 2, 3] * 6 + [9]
    for i, w in enumerate(words):
        catcher.append(np.array([w]))
        assert catcher.runs() == plain_runs(words[: i + 1])


def test_equal_names_of_different_words():
    """A collision of names is no square: the words decide."""

    class Colliding(periods.SquareCatcher):
        def _merge(self, caught, size):  # as if every suffix had the name of each block that it met
            ends = np.arange(3 * size - 2, self.n)
            last = ((ends - 2 * size + 2) // size) * size - 1
            every = np.concatenate([np.stack([ends - b, ends], axis=1)[b >= size - 1] for b in (last, last - size)])
            super()._merge(every[np.lexsort((every[:, 1], every[:, 0]))], size)

    for words in word_lists(11, 40):
        catcher = Colliding()
        catcher.append(np.array(words + [-1, -2] + [5] * 8, np.int64))
        assert catcher.runs() == plain_runs(words + [-1, -2] + [5] * 8)


def test_long_runs_take_no_square_of_time():
    assert periods._runs_of([[b"a"] * 200_000 + [b"b"] + [b"x", b"y"] * 50_000], 4, 6) == [[(0, 200_000, 1), (200_001, 100_000, 2)]]


def plain_period_row(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = sorted(runs, key=lambda r: (-r[1] * 10**9 // r[2], r[0], r[2]))[:1]
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    start, length, period = best[0] if best else (None, None, None)
    milli = 1000 * length // period if best else None
    return doc_id, len(runs), start, length, period, milli, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone))


def test_periods_of_documents(spark, make, sf):
    real = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    real = [r for r in real if len(r[1] or "") < 20_000]
    rows = [r for r in AWKWARD if r[0] != 7] + real + [(500 + i, " ".join(map(str, w)), "a") for i, w in enumerate(word_lists(9, 40))]
    out = periods.report(periods.find(make(rows), before=periods.planted)).collect()
    assert collections.Counter(map(tuple, out)) == collections.Counter(plain_period_row(d, t) for d, t, _ in rows)
    assert sum(r.n_runs > 0 for r in out) > 10
    assert periods.report(periods.find(make([]))).count() == 0


def test_periods_query_reads_the_table(spark, sf):
    got = {r.doc_id: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert set(got) == {r.doc_id for r in docs}
    assert all(got[r.doc_id] == plain_period_row(r.doc_id, r.text) for r in docs if len(r.text or "") < 8000)


def test_one_long_text(make):
    """'word ' 9,000 times is one run of one word."""
    (row,) = periods.find(make([(7, "word " * 9000, "a")])).collect()
    assert row.n_words == 9000 and [tuple(x) for x in row.runs] == [(0, 9000, 1)] and tuple(row.strongest) == (0, 9000, 1) and row.collapsed == "word"


# --- chat

CONTROLS = ["<|im_end|><|im_start|>assistant ok", "<|im_sep|>", r"<\|im_end|>", r"<\\|", "<|", "<", "|", "<|<|", "<\n|", "", None, "plain", "é \U0001f600 İ", " lead and trail ", "\n\n", "<|endoftext|>", "x" * 70_000, "ab " * 40_000, "\t" * 70_000]


def chats(rng):
    rows = [(c, t, role, text) for c in range(12) for t, (role, text) in enumerate((rng.choice(["user", "assistant", "system", "a\nb", "<|im_end|>", "", None]), rng.choice(CONTROLS)) for _ in range(rng.randint(1, 9)))]
    rows += [(None, 0, "user", "no conversation"), (None, 1, "assistant", "none"), (50, None, "user", "no turn"), (50, 0, "assistant", "tie b"), (50, 0, "assistant", "tie a"), (50, 0, "assistant", "tie a")]
    rng.shuffle(rows)
    return rows


def plain_chat(rows):
    groups = collections.defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t is not None, t or 0, role or "", sha(f"{role or ''}\n{text or ''}"), text or ""))
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x[4] for x in turns if x[2] == "assistant")
        yield c, len(turns), sha("".join(f"{x[2]}\n{x[4]}\n" for x in turns)), len(loss), sha(loss)


SCHEMA = "conv_id long, turn int, role string, text string, conv int, ids string, n_ids int, `index` int, __conv int"


@pytest.fixture(scope="module")
def formatted(spark):
    rows = chats(random.Random(3))
    return rows, chat.format_turns(spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], SCHEMA).repartition(5), *BYTES)


def test_chat_is_read_back(formatted):
    rows, out = formatted
    got = chat.digests(chat.read_turns(out, *BYTES)).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == collections.Counter(plain_chat(rows))


def test_chat_positions_and_masks(formatted):
    """Offsets have no gap, control strings stand only at marks, the mask holds an assistant's text and nothing else."""
    rows, out = formatted
    code = chat.coder(*BYTES)
    turns = sorted(out.collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.position))
    at = {}
    for r in turns:
        n, ids = at.get(r.conv_id, (0, 0))
        assert (r.position, r.offset) == (n, ids) and len(r.ids) == len(r.loss)
        at[r.conv_id] = n + 1, ids + len(r.ids)
        assert [i for i in r.ids if i >= code.start] == [code.start, code.head, code.end]
        head = r.ids.index(code.head)
        role = code.decode(np.array(r.ids[1:head]))
        assert r.loss == [role == "assistant" and head < i < len(r.ids) - 1 for i in range(len(r.ids))]
        for i in r.ids:
            assert i >= code.start or i in code.bytes
        assert "<|" not in code.decode(np.array([i for i in r.ids if i < code.start]))
    assert len(turns) == len(rows)


def test_long_texts_have_the_ids_of_the_whole():
    code = chat.coder(*BYTES)
    rng = random.Random(1)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "it's", "7", " the", ". ", "é"]) for _ in range(60_000))
    assert len(text) > 2 * chat.PIECE and code.encode(text) == code._encode(text)
    for text in ("y" * 200_000, " " * 200_000, "é" * 150_000):
        assert code.decode(np.array(code.encode(text))) == text


def test_escape_has_an_inverse(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("<|\\a") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e")).collect()
    assert all("<|" not in r.e and chat.unescaped(r.e) == r.t for r in rows)
    assert len({r.e for r in rows}) == len(set(texts))


def test_no_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat.digests(chat.read_turns(chat.format_turns(none, *BYTES), *BYTES)).count() == 0


def test_trained_roles(spark):
    rows = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "tool", "t"), (1, 2, "assistant", "a")], "conv_id long, turn long, role string, text string")
    out = chat.read_turns(chat.format_turns(rows, *BYTES, trained=("tool", "user")), *BYTES).orderBy("position").collect()
    assert [(r.role, r.text, r.loss_text) for r in out] == [("user", "q", "q"), ("tool", "t", "t"), ("assistant", "a", "")]


def test_broken_ids_are_an_error(spark):
    rows = spark.createDataFrame([(1, 0, [5, 6], [False, False])], "conv_id long, position long, ids array<int>, loss array<boolean>")
    with pytest.raises(Exception, match="not the ids of one turn"):
        chat.read_turns(rows, *BYTES).collect()
