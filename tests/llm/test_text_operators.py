import base64
import collections
import fractions
import functools
import gzip
import hashlib
import io
import itertools
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from llm.awkward import AWKWARD
from tessera.llm import language, packing, pii, scoring, simhash, warc
from tessera.llm.common import components
from tessera.llm.queries import TOKENIZER


def lower(t):
    return (t or "").encode().lower()


def real(spark, sf, n=200):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").filter(f"doc_id < {n}").collect()]


# --- SimHash


def brute_fp(t, width=3):
    words = lower(t).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, most=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_near_groups_against_all_pairs(spark, make, sf):
    for rows in (AWKWARD, real(spark, sf)):
        fps = [brute_fp(t) for _, t, _ in rows]
        comp = brute_components(fps)
        best = {}
        for (d, _, _), c in zip(rows, comp):
            if d is not None:
                best[c] = min(best.get(c, d), d)
        want = collections.Counter((d, f"{f:016x}", best.get(c)) for (d, _, _), f, c in zip(rows, fps, comp))
        got = simhash.near_groups(make(rows)).collect()
        assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
        assert sum(r.kept for r in got) == len(set(comp))
        assert all(r.doc_id == r.component_id for r in got if r.kept)
    assert simhash.near_groups(make([])).count() == 0


@pytest.mark.parametrize("limit", [4, 40, 16384])
def test_links_in_dense_groups(spark, limit):
    """Clusters, chains and a crowd that share most bits, with groups split at small limits."""
    rng = np.random.default_rng(limit)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 300, dtype=np.uint64)}
    for centre in list(fps)[:6]:
        for _ in range(40):
            x = centre
            for b in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    fps |= {i for i in range(64)} | {(0xFFFF << 48) + i * 37 for i in range(200)}
    fps = sorted(fps)
    want = brute_components(fps)
    edges = simhash.link(spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long"), 3, limit).collect()
    at = {simhash.signed(x): i for i, x in enumerate(fps)}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in edges:
        assert want[at[r.a]] == want[at[r.b]]
        a, b = find(at[r.a]), find(at[r.b])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == want


def test_many_fingerprints_that_share_bits(spark):
    """Over 100,000 fingerprints agree in 40 bits: groups are split again and again, and planted links are found."""
    rng = np.random.default_rng(2)
    fps = set((rng.integers(0, 1 << 24, 110_000, dtype=np.uint64) | np.uint64(0xABCDEF0123 << 24)).tolist())
    edges = simhash.link(spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long"), 3, 2000)
    roots = {r.node: r.root for r in components(edges).collect()}
    find = lambda x: roots.get(simhash.signed(x), simhash.signed(x))
    near = lambda x: [y for k in (1, 2, 3) for bits in itertools.combinations(range(24), k) if (y := x ^ sum(1 << b for b in bits)) in fps]
    for x in sorted(fps)[::4000]:
        assert all(find(x) == find(y) for y in near(x))


def test_gray_index_finds_every_link():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    fps = np.unique(np.array([int(c) ^ sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for c in centre for _ in range(60)], np.uint64))
    rank = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    fps = fps[np.argsort(rank)]
    group = (np.arange(len(fps)) * 3) // len(fps)
    found = set()
    for q, first, last in simhash.GrayIndex(fps, group, 3).links(limit=500):
        for a, b, c in zip(q.tolist(), first.tolist(), last.tolist()):
            found |= {(a, x) for x in range(max(b, a + 1), c)}
    assert found == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if group[i] == group[j] and int(fps[i] ^ fps[j]).bit_count() <= 3}


def test_simhash_dedup(make):
    docs = make(AWKWARD)
    out = simhash.dedup(docs)
    assert out.columns == docs.columns and out.count() == len(set(brute_components([brute_fp(t) for _, t, _ in AWKWARD])))


# --- packing


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def tokens(t):
    return [*library().encode(t or "", add_special_tokens=False).ids, 1]


def test_pack_round_trip(spark, make, sf):
    for rows, block in ((AWKWARD, 128), (AWKWARD, 16), (real(spark, sf, 60), 128)):
        got = packing.pack(make(rows), TOKENIZER, block=block, keep_ids=True).collect()
        pieces = collections.defaultdict(list)
        for r in got:
            ids = np.frombuffer(r.ids, "<u4").tolist()
            assert len(ids) == r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32
            pieces[r.doc_id].append((r.start, ids, r.doc_tokens))
        want = collections.defaultdict(collections.Counter)
        for d, t, _ in rows:
            for i, x in enumerate(tokens(t)):
                want[d][i, x] += 1
        for d, ps in pieces.items():
            assert collections.Counter((s + i, x) for s, ids, _ in ps for i, x in enumerate(ids)) == want[d]
        assert set(pieces) == set(want)
        by = collections.defaultdict(list)
        for r in got:
            by[r.sequence_id].append((r.offset, r.length))
        assert sorted(by) == list(range(len(by)))
        for s, ps in by.items():
            at = 0
            for o, n in sorted(ps):
                assert o == at
                at += n
            assert at == 2048 or s == len(by) - 1
    assert packing.pack(make([]), TOKENIZER).count() == 0


def test_windows_keep_to_the_sources_shares(make):
    rows = [(i, " ".join(f"w{i} x y z" for _ in range(60)), "a" if i % 4 else "b") for i in range(200)]
    got = packing.pack(make(rows), TOKENIZER).collect()
    source = {d: s for d, _, s in rows}
    total, per = collections.Counter(), collections.defaultdict(collections.Counter)
    for r in got:
        total[source[r.doc_id]] += r.length
        per[r.sequence_id][source[r.doc_id]] += r.length
    run, share = collections.Counter(), total["b"] / sum(total.values())
    for s in range(max(per) - 1):  # deficits are carried, so running shares stay within a block of each source
        run += per[s]
        assert abs(run["b"] - share * sum(run.values())) <= 2 * 128


def scheduled(blocks, weights, per):
    """Deficit round-robin, a round after the other: the sources of the blocks in the order in which they are sent."""
    quantum = {s: fractions.Fraction(w) * per / sum(fractions.Fraction(x) for x in weights.values() if x > 0) for s, w in weights.items() if w > 0}
    left, deficit, out = dict(blocks), collections.Counter(), []
    while any(left.get(s) for s in quantum):
        for s in sorted(quantum, key=lambda s: "-" if s is None else "=" + s):
            deficit[s] += quantum[s]
            while deficit[s] >= 1 and left.get(s):
                deficit[s] -= 1
                left[s] -= 1
                out.append(s)
    return out + [s for s in sorted(left, key=lambda s: "-" if s is None else "=" + s) for _ in range(left[s])]


@pytest.mark.parametrize("weights", [{"a": 1, "b": 3, None: 2}, {"b": 0.5, "nowhere": 4}, {"a": 5, "b": 1, None: 0}])
def test_weights_against_a_scheduler(make, weights):
    rows = [(i, " ".join(f"w{i} x y z" for _ in range(30 + i % 7)), ["a", "b", None, "a"][i % 4]) for i in range(160)]
    got = packing.pack(make(rows), TOKENIZER, window=64, block=16, weights=weights).collect()
    source = {d: s for d, _, s in rows}
    size = collections.Counter()
    for d, t, s in rows:
        size[s] += len(tokens(t))
    at = {}
    for r in got:
        at |= {r.sequence_id * 64 + r.offset + i: source[r.doc_id] for i in range(r.length)}
    want = scheduled({s: n // 16 for s, n in size.items()}, weights, 4)
    assert [at[16 * i] for i in range(len(want))] == want
    assert all(len({at[16 * i + j] for j in range(16)}) == 1 for i in range(len(want)))
    assert sorted(at) == list(range(sum(size.values())))


def test_coder_equals_library():
    coder = packing.Coder(TOKENIZER)
    for t in [t for _, t, _ in AWKWARD if t] + ["It's WE'LL'd a--b 12½³ naïve\x85ß\xa0ŠŽ ...'s!", "é ﬁ ǅ", "a\x1cb", "''s 's't"]:
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == tokens(t)[:-1], t
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == tokens(t)[:-1]


# --- WARC


def test_round_trip(spark):
    pages = [(1, "http://a/", "<p>x</p>", 5), (2, None, "<p>x</p>", 5), (3, "http://a/\r\nX: y", None, 5), (4, "u", "", 5), (None, "u", "<p>x</p>", 5), (5, "ü", "é" * 50000, None), (6, "v", "a\r\n\r\nb\r\n", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, path int")
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert len(got) == len(pages)
    for p, _, html, _ in pages:
        data = (html or "").encode()
        assert got[p].payload_bytes == len(data) and got[p].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        same = [q for q, _, h, _ in pages if (h or "") == (html or "")]
        first = min(q for q in same if q is not None)
        assert (got[p].record_type, got[p].refers_to) == (("response", None) if p == first else ("revisit", first))
    assert {r.record_type for r in warc.round_trip(df, least=10).filter("page_id = 2").collect()} == {"response"}
    payload = {r.record_id.split(":")[2]: bytes(r.payload) for r in warc.read(warc.write(df), payload=True).collect()}
    assert payload["5"] == ("é" * 50000).encode() and payload["2"] == b"" and payload["6"] == b"a\r\n\r\nb\r\n"
    assert warc.round_trip(df.limit(0)).count() == 0


def test_reader_checks_what_it_reads():
    good = warc.member("urn:page:1:0", "u", b"hello", warc.digest(b"hello"), None)
    (head, block), (head2, _) = list(warc.records(io.BytesIO(good + good)))
    assert warc.parsed(head, block)[6] == b"hello" and head == head2
    assert gzip.decompress(good).startswith(b"WARC/1.1\r\n")
    text = gzip.decompress(good)
    for bad in (good[:-9], gzip.compress(re.sub(rb"Content-Length: \d+", b"Content-Length: 9", text, count=1)), gzip.compress(re.sub(rb"Content-Length: \d+", b"Content-Length: 999", text, count=1)), gzip.compress(text + b"more"), gzip.compress(b"GARBAGE\r\n\r\n")):
        with pytest.raises((ValueError, KeyError)):
            [warc.parsed(*r) for r in warc.records(io.BytesIO(bad))]
    with pytest.raises(ValueError, match="no end"):
        list(warc.records(io.BytesIO(gzip.compress(b"WARC/1.1\r\nX: " + b"y" * (warc.HEAD + 2 * warc.PIECE)))))
    with pytest.raises(ValueError):
        [warc.parsed(*r) for r in warc.records(io.BytesIO(gzip.compress(text.replace(b"hello", b"hallo"))))]


# --- PII


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m.group())
        if 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


TRICKY = ["a@b.c@d.e", "@a.b c@", "x.y%+-@host-1.co.uk.", "1.2.3.4.5.6.7.8", "256.1.1.1 001.2.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 010-9999.", "+12--3 +1", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5", "é\U0001f600 me@x.yz 1.1.1.1"]


def test_base_spans_against_patterns(spark, sf):
    import random

    random.seed(3)
    texts = TRICKY + [t for _, t, _ in real(spark, sf)] + ["".join(random.choices("a1.@+- (9)4\n", k=60)) for _ in range(3000)]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t), t


def test_disclosing_terms(make):
    rows = [(i, f"call Wintermute at w.mute@example.org about the matter {i}", "a") for i in range(5)] + [(i, f"the matter about call at number {i} and so on", "a") for i in range(5, 60)]
    got = {r.doc_id: r for r in pii.report(make([*rows, (99, None, "a"), (100, "", "a")])).collect()}
    assert got[0].n_email == 1 and f"email:19:37" in got[0].spans and "remove:5:15" in got[0].spans
    assert "generalise:0:4" not in got[0].spans and "remove:41:" not in got[0].spans  # "call", "about" and "the" are everywhere
    assert got[7].spans == got[99].spans == got[100].spans == ""
    assert got[0].base_sha256 == hashlib.sha256(b"email:19:37").hexdigest() and got[7].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r.text for r in pii.sanitised(make(rows)).collect()}
    assert clean[0] == "call  at [EMAIL] about the matter 0" and clean[7] == rows[7][1]
    assert pii.report(make([])).count() == 0


def brute_disclosed(rows, support=3, threshold=0.8, certain=0.99, near=8, reach=200):
    """Spans beyond the base ones, by the definition: counts over all documents, then every occurrence in those that hold the entity."""
    term = re.compile(r"[^\W\d_]{3,}")
    holds, pairs, has = collections.defaultdict(set), collections.defaultdict(set), collections.defaultdict(set)
    for n, (_, t, _) in enumerate(rows):
        t, base = t or "", brute_spans(t or "")
        for w in set(term.findall(t.lower())):
            has[w].add(n)
        free = [m for m in term.finditer(t) if all(m.end() <= s or m.start() >= e for s, _, e in base)]
        for s, k, e in base:
            holds[k, t[s:e].lower()].add(n)
            before = [m for m in term.finditer(t[:s]) if m.start() > s - reach or s <= reach][-near:]
            after = [m for m in term.finditer(t) if m.start() >= e and (m.end() < e + reach or len(t) <= e + reach)][:near]
            spots = {m.span() for m in before} | {m.span() for m in after}
            for m in free:
                if m.span() in spots:
                    pairs[(k, t[s:e].lower()), m.group().lower()].add(n)
    told = {}
    for (c, w), docs in pairs.items():
        information = math.log2(len(rows) / len(holds[c]))
        pmi = math.log2(len(docs) * len(rows) / (len(holds[c]) * len(has[w])))
        if len(docs) >= support and information > 0 and pmi / information >= threshold:
            told[c, w] = "remove" if pmi / information >= certain else "generalise"
    out = []
    for n, (_, t, _) in enumerate(rows):
        t, mine = t or "", {}
        for m in term.finditer(t):
            kinds = {k for (c, w), k in told.items() if n in holds[c] and w == m.group().lower()}
            if kinds and all(m.end() <= s or m.start() >= e for s, _, e in brute_spans(t)):
                mine[m.span()] = max(kinds)
        out.append({f"{k}:{s}:{e}" for (s, e), k in mine.items()})
    return out


def test_disclosure_against_the_definition(make):
    import random

    random.seed(11)
    words, texts = [f"{a}{b}{c}" for a in ("gar", "mol", "tis") for b in ("en", "ov", "ul") for c in ("da", "rik", "sem", "to")], []
    people = [(f"{w}@mail.example.org", w.capitalize(), random.choice(words)) for w in ("anselmo", "bertrand", "cyprian", "dorothea")]
    for n in range(160):
        text = random.choices(words, k=random.randint(0, 40))
        for address, name, other in random.sample(people, n % 3):
            at = random.randint(0, len(text))
            text[at:at] = [name, address] if n % 4 else [other, address, "4111 1111 1111 1111"]
            if n % 5 == 0:
                text.append(name)
        texts.append(" ".join(text))
    rows = [(n, t, "a") for n, t in enumerate([*texts, None, ""])]
    for options in ({}, {"near": 2, "support": 2, "threshold": 0.4, "certain": 0.7}, {"near": 3, "reach": 14}):
        want = brute_disclosed(rows, **options)
        got = {r.doc_id: set(filter(lambda s: s.split(":")[0] in ("generalise", "remove"), r.spans.split(","))) for r in pii.report(make(rows), **options).collect()}
        assert [got[n] for n in range(len(rows))] == want
        assert options.get("reach") or sum(map(len, want)) > 20


def test_terms_go_far_from_the_entity_too_and_generalise(make):
    far = " and so on with other words that say nothing in particular to anyone who reads them"
    rows = [(i, f"Wintermute w.mute@example.org{far * 5} Wintermute again", "a") for i in range(6)] + [(i, f"Wintermute is a name{far}", "a") for i in (6,)] + [(i, f"number {i}{far}", "a") for i in range(7, 90)]
    got = {r.doc_id: r.text for r in pii.sanitised(make(rows)).collect()}
    assert got[0].startswith("W\u2026 [EMAIL] and so on") and got[0].endswith("W\u2026 again") and got[6] == rows[6][1]


def test_pii_of_awkward_rows(make):
    rows = [(i, t, "a") for i, t in enumerate(TRICKY)] + AWKWARD[:8]
    got = pii.report(make(rows)).collect()
    want = collections.Counter((d, hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute_spans(t or "")).encode()).hexdigest()) for d, t, _ in rows)
    assert collections.Counter((r.doc_id, r.base_sha256) for r in got) == want


# --- language


def test_languages_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    train = docs.withColumn("lang", __import__("pyspark").sql.functions.when(docs.doc_id % 3 > 0, docs.lang))
    got = {r.doc_id: r for r in language.of_documents(train).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [d for d in truth if d % 3 == 0]
    assert sum(got[d].language == truth[d] for d in held) >= 0.97 * len(held)
    assert sum(r.accepted for r in got.values()) >= 0.98 * len(got)


def test_evidence_outweighs_and_fills_in(spark):
    text = {"en": "the cat and the dog went with their friend to the river ", "de": "der hund und die katze gehen mit ihrem freund zum fluss "}
    rows = [(i, f"http://h{i % 3}.shop.{t}/x", f'<html lang="{lang}"><body>{text[lang] * 4}</body>') for i, (lang, t) in enumerate([("en", "com"), ("de", "de")] * 30)]
    rows += [(100, "http://h1.shop.de/y", '<html lang="en"><p>' + text["de"] * 4), (101, "http://h1.shop.de/z", "<p>x</p>"), (102, None, None), (103, "http://h.de/", "<p>" + "".join(chr(0x3400 + 7 * i) for i in range(900)))]
    got = {r.page_id: r for r in language.of_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[100].language == "de" and got[101].language == "de" and got[0].language == "en"
    assert got[103].language == language.NO_LANGUAGE and not got[103].accepted
    assert len(got) == len(rows)


def brute_posteriors(rows, temper=0.3, strength=20.0, unknown=1e-3):
    """Posteriors of (text, declared, suffix, host) rows, a row at a time and without arrays of Spark."""
    b = language.BUCKETS
    grams = lambda t: [h for part in language.trigrams((t or "").encode()) for h in part.tolist() if h < b]
    langs = sorted({d for t, d, _, _ in rows if d and t and grams(t)})
    logs = []
    for lang in langs:
        n = np.zeros(b)
        for t, d, _, _ in rows:
            if d == lang:
                np.add.at(n, grams(t), 1)
        n += min(0.5, 0.5 * n.sum() / b)
        logs.append(np.log(n / n.sum()))
    logs.append(np.full(b, -math.log(b)))
    k = len(langs)
    prior = [(1 - unknown) / max(1, k)] * k + [unknown]
    told, own = [], []
    for t, *_ in rows:
        s = np.array([temper * x[grams(t)].sum() for x in logs])
        told.append(s - s.max())
        p = np.exp(told[-1]) * prior
        own.append(p / p.sum())
    total = sum(own)
    p0 = (total + 1) / (len(rows) + k + 1)
    parent = lambda h: h.split(".", 1)[1] if h and re.match(r"[^.]+\..", h) else None
    out = []
    for i, (_, d, s, h) in enumerate(rows):
        def share(value, key, towards):
            if value is None:
                return towards
            n = np.maximum(0, sum(own[j] for j in range(len(rows)) if key(rows[j]) == value) - own[i])
            return (n + strength * towards) / (n.sum() + strength)

        p1 = share(parent(h), lambda r: parent(r[3]), p0)
        p2 = share(h, lambda r: r[3], p1)
        log = np.log(p2) + told[i] + np.log(share(d, lambda r: r[1], p0) / p0) + np.log(share(s, lambda r: r[2], p0) / p0)
        p = np.exp(log - log.max())
        out.append(p / p.sum())
    return [*langs, language.NO_LANGUAGE], out


def test_posteriors_against_the_definition(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    vocabulary = {"en": "the cat dog went with friend river and".split(), "de": "der hund katze gehen mit freund fluss und".split(), "fr": "le chat chien avec ami vers fleuve et".split()}
    rows = []
    for i in range(90):
        lang = list(vocabulary)[i % 3]
        text = " ".join(rng.choice(vocabulary[lang if i % 11 else "de"], 1 + i % 9)) if i % 13 else None
        rows.append((text, lang if i % 4 else (None, "en")[i % 8 == 0], ("com", "de", None)[i % 5 % 3], (f"h{i % 4}.shop.{lang}", f"www.{lang}.org", "plain", None)[i % 7 % 4]))
    names, want = brute_posteriors(rows)
    docs = spark.createDataFrame([(i, *r, 1) for i, r in enumerate(rows)], "doc_id long, text string, declared string, suffix string, host string, told int")
    got = {r.doc_id: r for r in language.identify(docs, F.col("declared"), F.col("suffix"), F.col("host")).collect()}
    for i, p in enumerate(want):
        assert abs(got[i].posterior - p.max()) < 1e-5 and (got[i].language == names[p.argmax()] or np.sort(p)[-2] > p.max() - 1e-5), i
    assert len({r.language for r in got.values()}) >= 3


def test_rare_languages_are_profiled(spark, sf, monkeypatch):
    monkeypatch.setattr(language, "HELD", 2, raising=False)
    many = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] * 10
    rng = np.random.default_rng(5)
    said = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(120))
    rare = [(10**6 + i, said("\u03b1\u03b2\u03b3\u03b4\u03b5\u03b6"), "el", "s") for i in range(6)] + [(10**6 + 10 + i, said("kjwzyx"), "pl", "s") for i in range(6)]
    junk = [(10**6 + 21, said("!?%&#~^|"), None, "s"), (10**6 + 22, None, "xx", "s"), (10**6 + 23, said("QVW\u0436\u0448"), "und", "s")]
    docs = spark.createDataFrame([*many, *rare, *junk], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in language.of_documents(docs).filter(f"doc_id >= {10**6}").collect()}
    assert len(rare) < 0.01 * docs.count()
    assert all((got[d].language, got[d].accepted) == (lang, True) for d, _, lang, _ in rare)
    assert got[10**6 + 21].language == got[10**6 + 23].language == language.NO_LANGUAGE


def test_language_of_awkward_rows(make, spark):
    docs = make(AWKWARD)
    assert language.of_documents(docs).count() == len(AWKWARD)
    out = language.accepted_only(docs)
    assert out.columns == docs.columns
    assert language.of_documents(make([])).count() == 0
    unlabelled = docs.drop("lang").selectExpr("*", "cast(null as string) AS lang")
    assert {r.language for r in language.of_documents(unlabelled).collect()} == {language.NO_LANGUAGE}


# --- language model


def brute_base(rows):
    tok = lambda t: [*lower(t).split(), b""]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    c = collections.Counter(w for d, t, _ in rows if not held(d) for w in tok(t))
    n, v = sum(c.values()), len(c)
    return [(d, held(d), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t))) for d, t, _ in rows]


def test_base_scores(spark, make, sf, monkeypatch):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    for rows, common in ((AWKWARD, 1_000_000), (AWKWARD, 3), (real(spark, sf), 500)):
        monkeypatch.setattr(scoring, "COMMON", common)
        got = scoring.score(make(rows), rounds=2).collect()
        have = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], key=key)
        want = sorted(brute_base(rows), key=key)
        assert [h[:5] for h in have] == [w[:5] for w in want]
        assert np.allclose([h[5] for h in have], [w[5] for w in want])
        assert all(np.isfinite(r.score) and r.score <= 0 for r in got)


def test_model_beats_the_base_on_held_out_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    r = scoring.score(docs).filter("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert r.s > r.b + 0.01 * abs(r.b)


def random_model():
    rng = np.random.default_rng(3)
    model = scoring.Model(rng.integers(1, 50, scoring.UNITS).astype(float))
    for w in model.class_w.values():
        w += rng.normal(size=w.shape, scale=0.3)
    model.slot_w = rng.normal(size=model.slot_w.shape, scale=0.5).astype(np.float16)
    return rng, model


def test_model_is_a_distribution():
    _, model = random_model()
    norm, u = model.norms(), np.arange(scoring.UNITS)
    for ctx in (0, 20, scoring.CONTEXTS - 1):
        one = ctx // (scoring.SKIPS + 1)
        for classes in (model, model.only_classes()):
            logp = classes.classes(np.array([ctx]))[0, u // scoring.SLOTS] + model.slot_bias.ravel() + model.slot_w[one] - norm[one, u // scoring.SLOTS]
            assert abs(np.exp(logp.astype(float)).sum() - 1) < 1e-4


def test_gradients_by_finite_differences():
    rng, model = random_model()
    n = 400
    context, cls, count = rng.integers(0, 40, n), rng.integers(0, scoring.CLASSES, n), rng.integers(1, 9, n)
    likelihood = lambda: (count * model.classes(context)[np.arange(n), cls]).sum()

    def slope(array, at, value):
        array[at] += 1e-4
        high = value()
        array[at] -= 2e-4
        low = value()
        array[at] += 1e-4
        return (high - low) / 2e-4

    found = list(scoring.class_sums(model, context, cls, count))
    assert {name for name, _, _ in found} == set(model.class_w)
    for name, ids, sums in found:
        for i, j in zip(rng.integers(0, len(ids), 6), rng.integers(0, scoring.CLASSES, 6)):
            assert abs(slope(model.class_w[name], (ids[i], j), likelihood) - sums[i, j]) < 1e-4 * (1 + abs(sums[i, j])), name
    seen, w = rng.integers(0, 5, (3, scoring.CLASSES, scoring.SLOTS)).astype(float), rng.normal(size=(3, scoring.CLASSES, scoring.SLOTS))
    gradient, _ = scoring.slot_gradient(seen, model.slot_bias, w)

    def slot_likelihood():
        logits = model.slot_bias + w
        return (seen * (logits - np.log(np.exp(logits).sum(axis=-1, keepdims=True)))).sum()

    for at in zip(rng.integers(0, 3, 9), rng.integers(0, scoring.CLASSES, 9), rng.integers(0, scoring.SLOTS, 9)):
        assert abs(slope(w, at, slot_likelihood) - gradient[at]) < 1e-3


def plain_scores(rows, rounds, prior=1.0):
    """The same model, trained and applied a token at a time on the driver."""
    token = lambda t: [*lower(t).split(), b""]
    learn = [token(t) for d, t, _ in rows if zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2]
    c = collections.Counter(w for t in learn for w in t)
    rank = {w: i for i, w in enumerate(sorted(c, key=lambda w: (-c[w], w))[: scoring.PREVIOUS // 2])}
    own = {w for w, i in rank.items() if i < scoring.OWN}
    unit = lambda w: rank[w] if w in own else scoring.OWN + zlib.crc32(w) % (scoring.UNITS - scoring.OWN)
    before = lambda w: rank[w] if w in rank else scoring.PREVIOUS // 2 + (zlib.crc32(w) >> 12) % (scoring.PREVIOUS // 2)
    mass, kinds = np.zeros(scoring.UNITS), np.zeros(scoring.UNITS)
    for w, n in c.items():
        mass[unit(w)] += n
        kinds[unit(w)] += w not in own

    def walk(words):
        one, two = scoring.START, scoring.SKIPS
        last = None
        for w in words:
            yield one * (scoring.SKIPS + 1) + two, one, unit(w), w
            one, two = before(w), scoring.SKIPS if last is None else unit(last) * scoring.SKIPS // scoring.UNITS
            last = w

    seen = collections.Counter((context, u // scoring.SLOTS) for t in learn for context, _, u, _ in walk(t))
    model = scoring.Model(mass)
    cells = [np.array(x) for x in zip(*seen)] + [np.array(list(seen.values()))]
    for _ in range(rounds):
        sums = {k: np.zeros((len(v), 2 * scoring.CLASSES)) for k, v in model.class_w.items()}
        for name, ids, part in scoring.class_sums(model, *cells):
            sums[name][ids] += part
        model.step(sums, prior)
    follow = collections.defaultdict(lambda: np.zeros(scoring.UNITS))
    for t in learn:
        for _, one, u, _ in walk(t):
            follow[one][u] += 1
    bias = model.slot_bias
    weights = {}
    for one, n in follow.items():
        n, w = n.reshape(bias.shape), np.zeros(bias.shape)
        for _ in range(rounds):
            share = np.exp(bias + w) / np.exp(bias + w).sum(axis=1, keepdims=True) * n.sum(axis=1, keepdims=True)
            w = w + np.clip((n - share - prior * w) / (share + prior), -1, 1)
        weights[one] = w
    out = []
    for d, t, _ in rows:
        total = 0.0
        for context, one, u, w in walk(token(t)):
            logits = (bias + weights.get(one, 0))[u // scoring.SLOTS]
            p = model.classes(np.array([context]))[0, u // scoring.SLOTS] + logits[u % scoring.SLOTS] - np.log(np.exp(logits).sum())
            total += p / math.log(10) + (0 if w in own else math.log10((c[w] + 1) / (mass[u] + kinds[u] + 1)))
        out.append((d, total))
    return out


def test_scores_equal_a_plain_scorer(spark, make, sf):
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    for rows in (AWKWARD[:8] + AWKWARD[10:], real(spark, sf, 25)):
        got = sorted(((r.doc_id, r.score) for r in scoring.score(make(rows), rounds=3).collect()), key=key)
        want = sorted(plain_scores(rows, 3), key=key)
        assert [g[0] for g in got] == [w[0] for w in want]
        assert np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-4, atol=1e-3)


def test_scoring_nothing(make):
    assert scoring.score(make([])).count() == 0
