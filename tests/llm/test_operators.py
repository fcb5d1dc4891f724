"""Each corpus operator against brute force, a round trip or held-out accuracy; nulls, empties, ties, empty tables, further columns."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchloom.llm import chat, decontaminate, language, mixing, near_dedup, packing, pii, quality, secrets, wrapper
from watchloom.llm.queries import QUERIES, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, found string, rank int"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, one word, a repeated row, a long text, a null id; clashing further columns."""
    return spark.createDataFrame([(1, None, "en", "x", 1), (2, "", None, None, None), (3, "one", "en", "x", 2), (4, "a b c d e f " * 20_000, "en", "x", 3), (5, "same text of a few words here", "en", "x", 4), (5, "same text of a few words here", "en", "x", 4), (None, "no id but words and more words", None, None, None), (6, "### 123 ***", "en", "y", 5)], DOCS)


def shingles(text, n, short=False):
    w = (text or "").encode().lower().split()
    if short and 0 < len(w) < n:
        return {tuple(w)}
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_near_duplicates(docs, rows):
    sets = {r.doc_id: shingles(r.text, 4, True) for r in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]) and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, shingle=4).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_near_duplicates_odd(odd, spark):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd, shingle=4).collect())
    assert len(got) == 8 and (1, 0, 1, True) in got and (3, 1, 3, True) in got
    assert [g for g in got if g[0] == 5] == [(5, 4, 5, True)] * 2
    assert near_dedup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_chain_of_near_copies(spark):
    """Links that only hold step by step: every neighbour is similar, the ends are not."""
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[:20] + [f"v{j}" if j < 5 * k else words[j] for j in range(20, 200)]) for k in range(30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.component_id for r in near_dedup.near_duplicates(df, shingle=4).collect()} == {0}


def planted_family(rng, n, least, most, tail=""):
    """A base text of 150 words and n copies with least to most words replaced."""
    base = [f"w{i}" for i in range(150)]
    out = []
    for j in range(n):
        w = list(base)
        for at in rng.choice(150, rng.integers(least, most + 1), replace=False):
            w[at] = f"x{tail}{j}_{at}"
        out.append(" ".join(w))
    return out


def test_large_families_of_near_copies_and_near_misses(spark):
    """2000 copies with up to four words replaced, and 2000 that stay just short of the threshold, against all pairs."""
    rng = np.random.default_rng(5)
    texts = planted_family(rng, 1, 0, 0) + planted_family(rng, 1999, 1, 8) + [t.replace("w", "m") for t in planted_family(rng, 2000, 5, 6, "m")]
    # some of the near misses differ from another one in one word only
    texts += [t.replace("m10 ", "other ") for t in texts[2000:2050]]
    place, n = {}, len(texts)
    sets = [[place.setdefault(s, len(place)) for s in shingles(t, 4)] for t in texts]
    holders = [[] for _ in place]
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    both = np.zeros((n, n), np.int32)
    for h in holders:
        if len(h) > 1:
            both[np.ix_(h, h)] += 1
    size = np.array([len(s) for s in sets])
    linked = 100 * both >= 80 * (size[:, None] + size[None, :] - both)
    low = np.arange(n)
    while True:
        new = np.minimum(low, np.where(linked, low[None, :], n).min(axis=1))
        if (new == low).all():
            break
        low = new
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, shingle=4).collect()}
    assert got == dict(enumerate(low.tolist())) and 1000 < len(set(low.tolist())) < 4000


def test_rows_that_repeat_an_id_with_other_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(7, a), (7, b), (7, b), (3, b + " more"), (None, a), (None, "alone without any id")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, shingle=4).collect()), key=str)
    assert got == sorted([(7, 37, 7, True), (7, 37, 3, False), (7, 37, 3, False), (3, 38, 3, True), (0, 37, 7, False), (0, 1, None, True)], key=str)


def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(docs, tokenizer_path(), with_ids=True).toPandas()
    texts = {r.doc_id: r.text or "" for r in rows}
    for doc, part in got.sort_values(["doc_id", "piece"]).groupby("doc_id"):
        ids = tok.encode(texts[doc], add_special_tokens=False).ids + [0]
        assert [i for p in part.ids for i in p] == ids
        assert list(part.start) == [2048 * i for i in range(len(part))]
        assert all(zlib.crc32(np.array(p, "<u4").tobytes()) == c for p, c in zip(part.ids, part.ids_crc32, strict=True))
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert list(part.offset) == [0, *part.length.cumsum()[:-1]] and part.length.sum() <= 2048
    assert got.sequence_id.nunique() <= 1.02 * math.ceil(got.length.sum() / 2048) + 1


def test_packing_odd(odd, spark):
    got = packing.pack(odd, tokenizer_path()).collect()
    assert {r.doc_id: r.length for r in got if r.doc_id in (1, 2)} == {1: 1, 2: 1}
    assert len([r for r in got if r.doc_id == 5]) == 2
    assert packing.pack(spark.createDataFrame([], DOCS), tokenizer_path()).count() == 0


def test_word_by_word_encoding_is_exact(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    texts = ["It's 2,000.50 <|endoftext|>x İstanbul ΣΣ naïve étude, \x1c a b c ... end., (x).", "DON'T stop\r\n\tno\x0bw <|startoftext|>", "", "你好 \U0001f600! ẞ"]
    texts.append(" ".join(dict.fromkeys(w for t in rows for w in (t.text or "").split())))
    ids, ends = packing.word_ids(tokenizer_path())(texts)
    for a, b, text in zip([0, *ends[:-1]], ends, texts, strict=True):
        assert list(ids[a:b]) == tok.encode(text, add_special_tokens=False).ids


def test_plan_uses_exact_fills():
    claims, n = packing.plan({1000: 3, 1048: 3, 512: 8, 700: 2, 648: 2}, 2048)
    assert n == 3 + 2 + 2


def test_decontamination_finds_items_in_long_texts(spark, docs, rows, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = set()
    sets = {r.item_id: shingles(r.text, 5) for r in items.collect()}
    for r in rows:
        own = shingles(r.text, 5)
        want |= {(r.doc_id, i) for i, s in sets.items() if s and 100 * len(s & own) >= 80 * len(s)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()} == want
    item = items.first()
    long = spark.createDataFrame([(1, "filler words go on " * 30_000 + item.text + " and on " * 9000), (2, None), (3, "short")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(long, items).collect()] == [(1, item.item_id)]
    assert decontaminate.leaks(long, items.where("false")).count() == 0
    assert [r.doc_id for r in decontaminate.without_leaks(long, items).orderBy("doc_id").collect()] == [2, 3]
    small = decontaminate.leaks(docs, items, block_items=7)
    assert {(r.doc_id, r.item_id) for r in small.collect()} == want


def test_quality_verdict_does_not_depend_on_order(docs, odd):
    a = {r.doc_id: r.kept for r in quality.judge(docs, order=[r.name for r in quality.RULES]).collect()}
    b = {r.doc_id: r.kept for r in quality.judge(docs, order=[r.name for r in reversed(quality.RULES)]).collect()}
    assert a == b and any(a.values()) and not all(a.values())
    got = quality.judge(odd).collect()
    assert len(got) == 8 and not any(r.kept for r in got if r.doc_id in (1, 2))
    assert len(quality.profile(docs)) == len(quality.RULES)


def test_secrets(docs, rows, odd):
    got = {r.doc_id: r for r in secrets.secrets(docs).collect()}
    for r in rows:
        t = r.text or ""
        spans = [(m.start(), m.end(), 0) for m in re.finditer(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 6]
        spans += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], x[2])))
        assert got[r.doc_id].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert all(r.spans == [] for r in secrets.secrets(odd).collect())
    judge = secrets.Novelty()
    assert secrets.scan("auth secret is Zx9Kq2LmP0vTr8WbY4nJ and more", judge)[1] == [(15, 35, "novel")]
    assert secrets.scan("the token refresh_token_expires_in_2024 ok", judge) == ([], [])


def test_planted_secrets_recall_and_precision(spark, docs):
    rng, letters = np.random.default_rng(11), np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    planted = [f"the bearer value {''.join(rng.choice(letters, 24))} is set" for _ in range(100)]
    clean = [f"the bearer value my_service_handler_settings_v{i} is set in /etc/app/conf.d/service-{i}/settings" for i in range(100)]
    df = spark.createDataFrame(list(enumerate(planted + clean)), "doc_id long, text string")
    got = {r.doc_id: r.n_novel for r in secrets.secrets(df).collect()}
    found, false = sum(got[i] > 0 for i in range(100)), sum(got[i] > 0 for i in range(100, 200))
    assert found >= 95 and false <= 2
    assert "settings" not in secrets.identifiers(docs.where("false")) and "bearer" in secrets.identifiers(df)
    assert secrets.secrets(df.where("false")).count() == 0


def test_chat_round_trip(spark):
    said = [(1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (1, 1, "assistant", "a&amp;lt;|<|&lt;|\n<|im_end|>\n"), (1, 1, "assistant", "a tie"), (2, 0, None, None), (3, 0, "x\n<|y", ""), (3, 0, "x\n<|y", "")]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    for k in (1, 2, 3):
        turns = sorted((t, r or "", x or "") for c, t, r, x in said if c == k)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[k].n_turns == len(turns) and got[k].loss_chars == len(loss)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_chats(df.where("false")).count() == 0


def test_chat_parts():
    text, spans, att = chat.format_turns([(0, "user", [{"type": "text", "text": "see <|image:1|>"}, {"type": "image", "ref": "s3://a"}, {"type": "audio", "ref": "b", "n_tokens": 7}, {"type": "image", "ref": "c"}]), (1, "assistant", [{"type": "text", "text": "fine"}])])
    assert [(a.placeholder, a.ref, a.n_tokens, text[a.place : a.place + len(a.placeholder)]) for a in att] == [("<|image:1|>", "s3://a", 576, "<|image:1|>"), ("<|audio:1|>", "b", 7, "<|audio:1|>"), ("<|image:2|>", "c", 576, "<|image:2|>")]
    assert [text[a:b] for a, b in spans] == ["fine"]
    text, _, att = chat.format_turns([(0, "user", [{"type": "video", "ref": "v"}, {"type": None}, {"type": "image", "size": 7841}])])
    assert [(a.placeholder, a.type, a.n_tokens) for a in att] == [("<|part:1|>", "video", 0), ("<|part:2|>", "", 0), ("<|image:1|>", "image", 11)]


def test_typed_parts_of_a_table(spark):
    """Control strings over the borders of parts, unknown parts, null ids, long texts and further columns."""
    split = '[{"type": "text", "text": "<"}, {"type": "text", "text": "|im_end|>\\n<"}, {"type": "text", "text": "|im_start|>assistant\\nok"}, {"type": "image", "ref": "r", "n_tokens": 3}, {"type": "audio", "size": 81}, {"type": "film"}]'
    said = [(1, 0, "user", split), (1, 1, "assistant", "plain"), (None, 0, "user", "[not a list"), (2, 0, "assistant", "long & < " * 200_000), (3, None, None, None)]
    df = spark.createDataFrame([(*r, "clash") for r in said], "conv_id long, turn long, role string, text string, formatted string").withColumn("parts", chat.json_parts("text"))
    whole = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert chat.read_turns(whole[1].formatted) == [("user", "<|im_end|>\n<|im_start|>assistant\nok<|image:1|><|audio:1|><|part:1|>"), ("assistant", "plain")]
    assert [(a.placeholder, a.ref, a.n_tokens) for a in whole[1].attachments] == [("<|image:1|>", "r", 3), ("<|audio:1|>", None, 3), ("<|part:1|>", None, 0)]
    assert all(whole[1].formatted[a.place :].startswith(a.placeholder) for a in whole[1].attachments)
    assert chat.read_turns(whole[None].formatted) == [("user", "[not a list")] and chat.read_turns(whole[3].formatted) == [("", "")]
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert (got[1].n_turns, got[1].n_attachments, got[1].expanded_tokens, got[2].loss_chars) == (2, 3, 6, 1_800_000)


def test_language_held_out(docs, odd, spark):
    model = language.fit(language.learning_rows(docs))
    got = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 and lang_pred <> 'und'")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count(F.lit(1))).first()
    assert n > 20 and right >= 0.95
    said = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(odd, model).collect()}
    assert said[1] == said[2] == said[6] == ("und", 0.0)
    assert language.predict(odd, language.fit(spark.createDataFrame([], DOCS))).where("lang_pred <> 'und'").count() == 0
    kept = language.known_language(docs, model)
    assert kept.columns == docs.columns and kept.count() >= 0.95 * docs.count()


def test_language_of_symbols_beyond_the_basic_plane(docs, spark):
    emoji, gothic = "\U0001f600\U0001f680 \U0001f44d", "\U00010330\U00010331"
    assert language.term_counts(emoji) is None and language.term_counts(gothic) is not None
    for a, b in zip(language.term_counts(f"two {emoji} words"), language.term_counts("two words"), strict=True):
        assert (a == b).all()
    model = language.fit(docs)
    df = spark.createDataFrame([(1, emoji), (2, f"{emoji}\n")], "doc_id long, text string")
    assert {(r.lang_pred, r.score) for r in language.predict(df, model).collect()} == {("und", 0.0)}
    assert language.known_language(df, model).count() == 0


def test_mixing(docs, rows):
    got = {r.doc_id: r for r in mixing.scores(docs, hot_words=500).collect()}
    seen = Counter()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            seen.update([*(r.text or "").encode().lower().split(), b""])
    n, v = seen.total(), len(seen)
    for r in rows:
        w = [*(r.text or "").encode().lower().split(), b""]
        x = got[r.doc_id]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(w), sum(k in seen for k in w), n)
        assert math.isclose(x.base_score, sum(math.log10((seen[k] + 1) / (n + v + 1)) for k in w), rel_tol=1e-9)
        assert x.score < 0
    whole = {r.doc_id: r.score for r in mixing.scores(docs.repartition(3), hot_words=500).collect()}
    assert all(math.isclose(whole[k], got[k].score, rel_tol=1e-6) for k in whole)


def test_mixing_probabilities_sum_to_one():
    """Over all words of one byte and, for the rest, the bits of a first byte: each bit's two chances add up to one."""
    mixer = mixing.Mixer([np.zeros((1 << b, 2), np.float32) for b in (*mixing.SIZES, mixing.PREFIX_BITS)])
    mixer.train([b"abc", b"abd", b"xyz"] * 50, np.full(150, 5))
    flat = mixing.Bytes([bytes([i]) for i in range(256)])
    chance, every = np.zeros(len(flat.b)), np.arange(len(flat.b))
    for k in range(8):
        bits, slots = flat.bit(k)
        x, gate = mixer.inputs(slots, every, bits, k, None, None)
        c0 = ((np.uint64(1 << k) | (flat.b >> np.uint64(8 - k))).astype(np.int64)) * 8 + k
        p, _, _ = mixer.refine((x * mixer.weights[gate]).sum(axis=1), c0)
        chance += np.log(np.where(bits == 1, p, 1 - p))
    assert math.isclose(np.exp(chance[flat.starts]).sum(), 1, rel_tol=1e-9)
    assert 10 ** mixer.score([b"abc"])[0] > 10 ** mixer.score([b"qqq"])[0]


def test_no_word_is_lost_when_all_are_frequent(spark):
    words = spark.createDataFrame([(b"a", 9, 9), (b"b", 9, 9), (b"c", 1, 1)], "word binary, n long, seen long")
    assert mixing.hot_threshold(words, 2, top=8) == (8, 2) and mixing.hot_threshold(words, 1, top=8)[1] == 0
    text = " ".join(["a b"] * 40 + ["c"])
    docs = spark.createDataFrame([(i, text) for i in range(30)], "doc_id long, text string")
    got = mixing.scores(docs, hot_words=1).collect()
    assert all(r.n_known == r.n_tokens == 82 for r in got)


def test_mixing_odd(odd, spark):
    got = {r.doc_id: r for r in mixing.scores(odd).collect()}
    assert got[1].n_tokens == 1 and got[2].n_tokens == 1
    assert mixing.scores(spark.createDataFrame([], DOCS)).count() == 0


def test_mixing_counts_all_occurrences(docs, rows, spark):
    # the dictionary's size is a matter of cost only
    a = {r.doc_id: r.score for r in mixing.scores(docs, hot_words=500).collect()}
    b = {r.doc_id: r.score for r in mixing.scores(docs, hot_words=0).collect()}
    assert all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)
    words = spark.createDataFrame([(b"ab", 5, 5)], "word binary, n long, seen long")
    place = mixing.context_counts(words)[0]
    assert place.sum() == 5 * 3 * 8


def test_prefix_counts_over_ranges(spark, rows):
    seen = Counter(w for r in rows[:40] for w in (r.text or "").encode().lower().split())
    seen[b""] = 7
    table = [(w, n if i % 5 else 0, n) for i, (w, n) in enumerate(sorted(seen.items()))]
    want = Counter()
    for w, n, _ in table:
        bits = "".join(f"{x:08b}" for x in mixing.coded(w))
        for i in range(len(bits)):
            want[bits[: i + 1]] += n
    ranges = mixing.Ranges(spark.createDataFrame(table, "word binary, n long, seen long"), range_words=len(table) // 6)
    shared = ranges.shared.value
    parts, checked = ranges.words.toPandas().groupby("part"), 0
    assert len(parts) > 3 and shared
    for _, part in parts:
        own = sorted((mixing.coded(bytes(w)), n) for w, n in zip(part.word, part.n, strict=True))
        got = iter(mixing.prefix_counts([k for k, _ in own], np.array([n for _, n in own]), shared).reshape(-1, 2))
        for key, _ in own:
            bits = "".join(f"{x:08b}" for x in key)
            for i in range(len(bits)):
                assert tuple(next(got)) == (want[bits[:i] + "0"], want[bits[:i] + "1"])
                checked += 1
    assert checked > 1000


def test_pii(spark, odd):
    text = "a.b@x.example.com 4111 1111 1111 1111 4111111111111111 4111111111111112 123-45-6789 +1 (743) 555-3824 152.143.123.131 999.1.1.1 DE89370400440532013000 1984-02-29 30.02.1985 31/12/1999"
    df = spark.createDataFrame([(1, text), (2, f"again {text}"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, finds="finds").collect()}
    assert [f.kind for f in got[1].finds] == ["email", "card", "card", "ssn", "phone", "ip", "iban", "date", "date"]
    assert got[2].text == f"again {got[1].text}" and got[3].text is None and got[4].text == ""
    for kept in ("4111111111111112", "999.1.1.1", "30.02.1985"):
        assert kept in got[1].text
    for gone in ("a.b@x", "4111 1111 1111 1111", "123-45-6789", "555-3824", "152.143.123.131", "DE89370400440532013000", "1984-02-29"):
        assert gone not in got[1].text
    again = {r.doc_id: [f.kind for f in r.finds] for r in pii.pseudonymise(df.select("doc_id", F.lit(got[1].text).alias("text")), finds="finds").collect()}
    assert again[1] == [f.kind for f in got[1].finds]  # pseudonyms are valid numbers and dates themselves
    out = pii.pseudonymise(odd)
    assert out.columns == odd.columns and out.count() == 8


def test_pii_is_a_permutation(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("10."), F.floor(F.col("id") / 256).cast("string"), F.lit(".7."), (F.col("id") % 256).cast("string")).alias("text"))
    assert pii.pseudonymise(df).select("text").distinct().count() == 5000


def test_pii_permutes_dates_and_survives_long_texts(spark):
    days = [np.datetime64("1990-01-01") + i for i in range(2000)]
    text = [f"{str(d)[5:7]}/{str(d)[8:]}/{str(d)[:4]}" for d in days]
    text += [f"{str(d)[8:]}/{str(d)[5:7]}/{str(d)[:4]}" for d in days if int(str(d)[8:]) > 12]
    df = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    got = [r.text for r in pii.pseudonymise(df).orderBy("doc_id").collect()]
    assert len(set(got)) == len(text) and all(re.fullmatch(r"\d\d/\d\d/\d{4}", x) for x in got)
    assert all((int(a[:2]) > 12) == (int(b[:2]) > 12) for a, b in zip(got, text, strict=True))
    units = ["x@a" + ".a1" * 300_000, "a.b" * 300_000 + "@", "DE89 3704 " * 100_000, "4111-" * 200_000, "1.2.3." * 150_000, "+1 " * 300_000, "12/12/" * 150_000, "(123) " * 150_000, "1" * 1_000_000, "a@b.co " * 20_000]
    long = spark.createDataFrame(list(enumerate(units)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pseudonymise(long, finds="finds").collect()}
    assert len(out) == len(units) and len(out[9].finds) == 20_000 and len({f.pseudonym for f in out[9].finds}) == 1
    assert out[0].text == units[0] and out[8].text == units[8]
    same = spark.createDataFrame([(1, "010.1.1.1 and 10.1.1.1")], "doc_id long, text string")
    assert [f.kind for f in pii.pseudonymise(same, finds="finds").first().finds] == ["ip"]
    assert pii.pseudonymise(df.where("false"), finds="finds").count() == 0


def test_wrapper(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in wrapper.main_texts(pages).collect()}
    assert len(got) == pages.count() and all(r.n_chars == len(r.text) for r in got.values())
    page = "<html><body><header>Site</header><div class='cookie-notice'>We use cookies</div><div id=c><div>Home of news</div><div><p>{0} &amp; more<br>text</p><p>second {0}</p></div></div><aside>side</aside><section class=comments><p>nice</p></section><form>f</form></body></html>"
    df = spark.createDataFrame([(i, "http://h.example/" + str(i), page.format(f"story{i}")) for i in range(5)] + [(9, None, None), (10, "http://one.example/", "")], "page_id long, url string, html string")
    out = {r.page_id: r.text for r in wrapper.main_texts(df).collect()}
    assert out[3] == "story3 & more text\nsecond story3" and out[9] == out[10] == ""
    assert wrapper.main_texts(df.where("false")).count() == 0


def test_names_of_layout_states_are_no_boilerplate():
    story = "<p>the story itself, which is long enough to be most of it</p>"
    want = "the story itself, which is long enough to be most of it"
    for page in (f"<body class='has-sidebar'><article>{story}</article></body>", f"<html class='no-search'><body class='has-sidebar'><div id=page class='with-sidebar'>{story}</div></body></html>", f"<div id=page class='with-sidebar'><article>{story}</article><div class=sidebar><p>side</p></div></div>", f"<body><article class='post social'>{story}</article></body>", f"<main class='main search'>{story}<div class=comments>nice</div></main>"):
        assert wrapper.extract(page) == want
    assert wrapper.extract(f"<body><article><div class='page-header'><h1>Head</h1></div>{story}</article></body>") == f"Head\n{want}"
    assert wrapper.extract(f"<body><div class=sidebar><article><p>teaser</p></article></div><div>{story}</div></body>") == want


def test_wrapper_decides_within_articles():
    page = "<body><article><h1>Head {0}</h1><p>story {0} has its words</p><p>Read more on our site</p></article></body>"
    pages = [page.format(i) for i in range(5)]
    assert wrapper.extract(pages[2], *wrapper.induce(pages)) == "Head 2\nstory 2 has its words"
    # two pages may share a passage by chance
    assert wrapper.extract(pages[0], *wrapper.induce(pages[:2])).endswith("Read more on our site")
    # an article that is only a teaser is not the page's content
    page = "<body><article><p>Our best story, the same on all pages</p></article><div id=c><p>text {0} of the page</p><p>and more {0}</p></div></body>"
    pages = [page.format(i) for i in range(5)]
    assert wrapper.extract(pages[3], *wrapper.induce(pages)) == "text 3 of the page\nand more 3"


def test_broken_and_deep_pages(spark):
    began = time.perf_counter()
    story = "<p>the text {0}</p>"
    pages = ["<a " * 50_000, "<a \"" * 50_000, "<!" * 50_000, "</a " * 50_000, "<div>" * 10_000 + story.format("deep"), "<body>" + story.format("unclosed") + "<div class='x", "x < y and <b>z</b>", "<!-- open " + story.format("never")]
    got = [wrapper.extract(p) for p in pages]
    assert got == ["", "", "", "", "the text deep", "the text unclosed", "x < y and z", ""]
    for p in pages:
        wrapper.induce([p, p + "<p>other</p>", p + "<p>third</p>"])
    many = "<body><article>" + "".join(f"<p>line {i} of it</p>" for i in range(200_000)) + "</article></body>"
    assert wrapper.extract(many).count("\n") == 199_999
    assert time.perf_counter() - began < 60
    # slots decide on deep pages too
    deep = ["<body><div>About us</div>" + "<section>" * 3000 + f"<p>words {i} of page {i}</p><p>The same on all pages</p>" for i in range(5)]
    rows = [(i, "http://h.example/x", p) for i, p in enumerate(deep)] + [(7, "http://h.example/x", None), (8, "http://h.example/x", deep[0]), (8, "http://h.example/x", deep[0])]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, host string, text int")
    out = sorted((r.page_id, r.text) for r in wrapper.main_texts(df.drop("text")).collect())
    assert out == [*((i, f"words {i} of page {i}") for i in range(5)), (7, ""), (8, "words 0 of page 0"), (8, "words 0 of page 0")]


def test_inline_adverts_are_cut_and_formulas_stay():
    assert wrapper.extract("<body><article><p>a <span class='ad'>buy <span>x</span> y</span> b <math><mi>x</mi>=2</math> <b>c</b></p><p>d <span class=ad>open<p>e</p></article></body>") == "a b x=2 c\nd\ne"


def test_template_of_rare_layouts(spark):
    page = "<body><div class='{0}'><div>This is layout {0}</div><p>story {1} of the page</p></div></body>"
    rows = [(i, f"http://h.example/{i}", page.format(f"k{i % 9}", i)) for i in range(45)]
    rows += [(100 + i, "http://h.example/copy", page.format("k9", "copied")) for i in range(30)]
    got = {r.page_id: r.text for r in wrapper.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"story {i} of the page" for i in range(45))
    assert "story copied of the page" in got[100]


def test_tree_matching():
    a, b = (wrapper.Folded([wrapper.parse(f"<div><p>{t}</p><ul><li>x<li>y</ul></div>")]) for t in "pq")
    assert wrapper.tree_match(a, b) == 5


def test_near_dedup_stage_keeps_one_row_of_each(odd, spark):
    got = near_dedup.keep_one_of_each(odd)
    assert got.columns == odd.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter([1, 2, 3, 4, 5, None, 6])
    a, b = "one long sentence of words that is here for good", "another text which has nothing to do with the first one"
    df = spark.createDataFrame([(1, a), (7, b), (7, a), (None, b), (None, "a third text without any id that no one repeats")], "doc_id long, text string")
    assert sorted(r.text for r in near_dedup.keep_one_of_each(df).collect()) == sorted([a, b, "a third text without any id that no one repeats"])


def test_pipeline(spark, docs, sf_dir):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language", "near_dedup", "decontaminate", "pii", "packing"]
    got, want = docs, None
    for _, stage in P.STAGES[:-1]:
        got = stage(spark, got, sf_dir)
        assert got.columns == docs.columns
    want = {r.doc_id for r in got.select("doc_id").collect()}
    assert want and {r.doc_id for r in P.run(spark, sf_dir).select("doc_id").collect()} == want


def test_pipeline_on_odd_rows_and_an_empty_table(spark, sf_dir):
    import corpus_pipeline as P

    text = "the house of the old man is by the river and the children are playing in the garden with a small dog"
    rows = [(1, text, "en", "s", 9), (2, None, None, None, None), (3, "", "en", "s", 0), (None, text + " today", "en", "s", 9), (5, text, "en", "s", 9), (5, text, "en", "s", 9), (6, "### 123", "en", "s", 7), (7, "words " * 50_000, "en", "s", 9)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, found string")
    for empty in (False, True):
        got = docs.where("false") if empty else docs
        for _, stage in P.STAGES[:-1]:
            got = stage(spark, got, sf_dir)
            assert got.columns == docs.columns
        kept = Counter(r.doc_id for r in got.collect())
        # the copies are one, and so is the near copy without id
        assert kept == (Counter() if empty else Counter({1: 1, 7: 1}))
        assert P.packed(spark, got, sf_dir).count() >= len(kept)


def test_every_operator_has_a_query():
    assert [int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES] == list(range(1, 11))
