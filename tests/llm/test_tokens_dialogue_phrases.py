"""Byte-level BPE against its library, conversation repair against a full parse and Dijkstra-like search, phrases against plain counting."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from watchloom.llm import byte_bpe, decontaminate, dialogue, phrases
from watchloom.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, found string, n long, score int"


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts and languages, a long text, repeated rows, a null id; clashing further columns."""
    rows = [(1, None, "en", "x", 1, 1), (2, "", None, None, None, None), (3, "One two, one two. One\ttwo!", "en", "x", 2, 2), (4, "a b c d e f " * 20_000, "en", "x", 3, 3), (5, "same text of\na few words", "de", "x", 4, 4), (5, "same text of\na few words", "de", "x", 4, 4), (None, "no id", None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


# --- byte-level BPE


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return path, public_tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encodes_as_the_library(bpe):
    path, pattern, library = bpe
    rng = random.Random(2)
    texts = ["", " ", "<unk> <|endoftext|>", "a" * 100_000, "ab" * 30_000, "é" * 20_000, "日本語テスト" * 2_000, " " * 3_000 + "x", "\n\r\x0b\x00▁ Ġ", "don't we'll I'm 12345 ٣٤ \U0001f600\U0001f468‍\U0001f469"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x20, 0x3000), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(100)) for _ in range(200)]
    texts += ["".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 300))) for _ in range(500)]
    got = byte_bpe.Encoder(path, pattern).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode_ordinary(t) for t in texts]


def test_every_token_of_the_vocabulary(bpe):
    """A pre-token that is a token is that token; and the serialised model merges to it by itself."""
    path, pattern, library = bpe
    processor, back, whole = byte_bpe.model(path)
    assert len(back) == library.n_vocab and len(whole) == len(back)
    assert all(processor.encode(byte_bpe.mapped(t)) == [i + 1] for i, t in enumerate(back))


def test_round_trip_rows(spark, odd, bpe):
    path, pattern, library = bpe
    rows = odd.collect()
    got = byte_bpe.round_trip(odd, path, pattern).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    wanted = sorted(((r.doc_id, np.array(library.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode()) for r in rows), key=key)
    assert sorted(((r.doc_id, bytes(r.ids), bytes(r.bytes)) for r in got), key=key) == wanted
    both = byte_bpe.decode(byte_bpe.encode(odd, path, pattern), path)
    assert sorted(bytes(r.bytes) for r in both.collect()) == sorted(x[2] for x in wanted)
    assert byte_bpe.round_trip(odd.limit(0), path, pattern).count() == 0


def test_remembered_pretokens_may_be_forgotten(bpe, monkeypatch):
    path, pattern, library = bpe
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    encoder = byte_bpe.Encoder(path, pattern)
    for i in range(20):
        text = " ".join(f"word{i * j}x" for j in range(40))
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_op11(spark, sf_dir, bpe):
    library = bpe[2]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op11_byte_bpe"](spark, sf_dir).collect()}
    ids = {i: np.array(library.encode_ordinary(t), "<u4") for i, t in texts.items()}
    assert got == {i: (len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest()) for i, x in ids.items()}


# --- conversation repair

NEXT = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "3", ("3", "u"): "2"}


def search(rows):
    """(cost, audit, roles) of the cheapest edits of (initial, fault) rows: a walk over states, row by row."""

    def insert(now):
        for _ in range(3):
            for state, (cost, audit, out) in list(now.items()):
                for c in "ua":
                    new = NEXT.get((state, c))
                    if new and (new not in now or (cost + 2, audit + "I") < now[new][:2]):
                        now[new] = (cost + 2, audit + "I", out + c)
        return now

    now = insert({"0": (0, "", "")})
    for initial, fault in rows:
        after = {}
        for state, (cost, audit, out) in now.items():
            ways = [(state, cost + 3, "D", "")]
            if fault in (0, 3):
                extra = 1 if fault == 3 else 0
                ways += [(NEXT[state, initial], cost + extra, "K", initial)] if (state, initial) in NEXT else []
                ways += [(NEXT[state, c], cost + 2 + extra, "R", c) for c in "ua" if (state, c) in NEXT]
            for new, total, edit, c in ways:
                if new not in after or (total, audit + edit) < after[new][:2]:
                    after[new] = (total, audit + edit, out + c)
        now = insert(after)
    return min(v for k, v in now.items() if k in "03")


def every_split(rows):
    """The same by cells of all spans over all splits."""
    n = len(rows)
    cell = {(i, i + 1): dialogue._ROWS[c if c in ("s", "u", "a") else "", f] for i, (c, f) in enumerate(rows)}
    for width in range(2, n + 1):
        for i in range(n - width + 1):
            got = [dialogue.combined(cell[i, k], cell[k, i + width]) for k in range(i + 1, i + width)]
            assert all(g == got[0] for g in got)  # whatever the split
            cell[i, i + width] = got[0]
    return dialogue.cheapest(cell[0, n]) if n else (0, "")


def test_parse_against_search_and_all_splits():
    rng = random.Random(8)
    for _ in range(1500):
        rows = [(rng.choice(["s", "u", "a", "u", "a", "t", ""]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(0, 9))]
        span = dialogue.Span()
        for c, f in rows:
            span.add(dialogue._ROWS[c if c in ("s", "u", "a") else "", f])
        cost, audit, roles = search(rows)
        assert dialogue.cheapest(span.whole()) == (cost, audit) == every_split(rows)
        out = list(dialogue.applied(audit, iter([(c + "x" if c else "", "") for c, _ in rows])))
        assert "".join(r[:1] for r, _, _ in out) == roles and re.fullmatch("(s?(ua)+)?", roles)


def test_long_conversation_in_many_blocks(spark):
    """One conversation of 3000 rows over several ranges gives what one pass over its rows gives."""
    rng = random.Random(4)
    rows = [(7, i // 2 if i % 50 else None, rng.choice(["user", "assistant", "assistant", "system", "tool"]), rng.choice(["Yes.", "No", "", "x." + str(i)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    got = dialogue.report(df, df).collect()
    key = lambda r: hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], key(r)))
    seen, faults = set(), []
    for _, _, role, text in ordered:
        faults.append(1 if not text else 2 if (role, text) in seen else 3 if text[-1] not in ".!?" else 0)
        seen.add((role, text))
    cost, audit, _ = search([(r[2][:1], f) for r, f in zip(ordered, faults, strict=True)])
    out = dialogue.applied(audit, ((r[2], r[3]) for r in ordered))
    turns = [r[1] for r in ordered if r[1] is not None]
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(ordered, ordered[1:]))
    assert [tuple(r) for r in got] == [(7, max(turns) - min(turns) + 1 - len(set(turns)), faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b, _ in out).encode()).hexdigest())]


def test_repair_odd_rows(spark):
    rows = [(1, None, None, None, 0), (1, None, "user", "Hi.", 0), (None, 0, "user", "Hi.", 0), (None, 1, "assistant", "Yes.", 0), (3, 0, "", "x.", 0), (4, 0, "user", " \t\n", 0), (5, 0, "user", "same.", 0), (5, 0, "user", "same.", 0), (6, 2, "assistant", "y" * 500_000 + ".", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost int")
    got = {r.conv_id: r for r in dialogue.report(df, df).collect()}
    assert {k: (r.blank, r.duplicate, r.truncated, r.cost, r.audit) for k, r in got.items()} == {
        1: (1, 0, 0, 5, "DKI"), None: (0, 0, 0, 0, "KK"), 3: (0, 0, 0, 3, "D"), 4: (1, 0, 0, 3, "D"), 5: (0, 1, 0, 5, "KDI"), 6: (0, 0, 0, 2, "IK")
    }
    assert got[4].repaired_sha256 == hashlib.sha256(b"").hexdigest() and got[1].gaps == 0
    assert got[5].repaired_sha256 == hashlib.sha256(b"user:same.\nassistant:").hexdigest()
    gone = dialogue.report(df, df.where("conv_id <> 3 and conv_id is not null")).where("conv_id = 3 or conv_id is null").collect()
    assert len(gone) == 2 and all((r.cost, r.audit, r.gaps, r.repaired_sha256) == (0, "", 0, hashlib.sha256(b"").hexdigest()) for r in gone)
    assert dialogue.report(df.limit(0), df.limit(0)).count() == 0


# --- phrases


def plain_phrases(rows, least, percent, top):
    counts = {}
    for lang, text in rows:
        c = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({i: i + 32 for i in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3, 4):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inner = {}
        for p, a in cand.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inner[p[i:j]] = max(a, inner.get(p[i:j], 0))
        found = []
        for p, a in cand.items():
            if 100 * inner.get(p, 0) >= percent * a:
                continue
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        n = sum(v for p, v in c.items() if len(p) == 1)
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def as_rows(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_op13(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text").collect()
    assert as_rows(QUERIES["op13_phrases"](spark, sf_dir)) == plain_phrases(docs, 30, 80, 2000)


def test_phrases_with_bursts_and_spills(spark, monkeypatch):
    """Tiny bounds, so that containers burst, deeper nodes arise, subtrees are spilled and words forgotten."""
    rng = random.Random(6)
    words = ["the", "of", "é", "A", "b"] + [f"w{i}" for i in range(30)]
    rows = [(rng.choice(["en", "de", None]), " ".join(rng.choice(words[: rng.choice([3, 8, 35])]) + rng.choice(["", "", ".", "\n", "\t"]) for _ in range(80))) for _ in range(120)]
    for name, value in (("BURST", 8), ("BUDGET", 60), ("WORDS", 40)):
        monkeypatch.setattr(phrases, name, value)
    counted = {}
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] or "und" for r in rows]), pa.array([r[1] for r in rows])], names=["lang", "text"])
    runs = list(phrases.count_batches((1, 2, 3, 4), None, None)(batch.slice(i, 7) for i in range(0, len(rows), 7)))
    for run in runs:
        own = list(zip(run.column(0).to_pylist(), run.column(1).to_pylist(), strict=True))
        assert own == sorted(own, key=lambda x: (x[0].encode(), x[1].encode())) and len(set(own)) == len(own)
        for k, n in zip(own, run.column(2).to_pylist(), strict=True):
            counted[k] = counted.get(k, 0) + n
    assert len(runs) > 20
    wanted = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.lower()):
            w = re.findall(r"[^\x20\x09]+", piece)
            wanted.update((lang or "und", " ".join(w[i : i + k])) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    assert counted == dict(wanted)
    monkeypatch.undo()
    df = spark.createDataFrame(rows, "lang string, text string")
    assert as_rows(phrases.collocations(df, least=5, percent=80, top=40, salts=3)) == plain_phrases(rows, 5, 80, 40)


def test_phrases_odd(spark, odd):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert as_rows(phrases.collocations(odd, least=2)) == plain_phrases(rows, 2, 80, 2000)
    assert phrases.collocations(odd.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**18
    counts = spark.createDataFrame([("en", "a b", big - 1), ("en", "a", big), ("en", "b", big + 5)], "lang string, phrase string, n long")
    r = phrases.scored(counts.where("phrase = 'a b'"), counts).first()
    assert (r.score, r.l, r.r) == (2_000_000 * (big - 1) // (2 * big + 5), big, big + 5)


# --- decontamination by row


def test_leaking_rows_with_null_and_repeated_ids(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = spark.createDataFrame([(None, f"before {item} after", 1), (7, f"x {item}", 2), (7, "a clean row that shares its id with a leaking one", 3), (None, None, 4), (8, "", 5)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    kept = decontaminate.without_leaks(docs, items)
    assert sorted(r.item_id for r in kept.collect()) == [3, 4, 5] and kept.columns == docs.columns
    assert decontaminate.without_leaks(docs, items.limit(0)).count() == 5 and decontaminate.without_leaks(docs.limit(0), items).count() == 0
