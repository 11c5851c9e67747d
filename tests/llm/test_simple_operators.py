"""Secrets, language, exact dedup and packing against plain versions, and their edge cases."""

import hashlib
import os
import random
import re
import string
import time
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagemill.llm import exact_dedup, language_id, packing, secrets
from pagemill.llm.catalog import TOKENIZER, op8_exact_dedup
from pagemill.llm.common import scratch, shared_path
from pagemill.operators.sizing import checkpoint_folder

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep_id string, digest string, start string, score int"


def frame(spark, rows, parts=3):
    """Rows of (doc_id, text, lang); the further columns clash with names that operators use."""
    full = [(i, t, g, "src", None, "x", "y", "z", 1) for i, t, g in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


LONG = "word " * 60_000
TEXTS = [
    None, "", " ", "plain text", 'api_key = "abcdEFGH1234"', "token=short", "token=secret: abcdefgh99", "AKIA" + "X9" * 8, "AKIAAKIA1",
    "é" * 5 + " password: hunter2hunter2 " + "0123456789abcdef" * 3, "deadbeef" * 3, "ſecret=abcdefghij", LONG + "Secret='" + "q" * 20 + "'",
    "auth uses Zk9vQ2xT7mB4wR1yH6nD as given", "auth uses configuration_settings_1 as given",
]


def plain_base(text):
    found = []
    keyword = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
    keyword += "|[aA][pP][iI]_?[kK][eE][yY]"
    for m in re.finditer("(" + keyword + ")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m.group(2)) >= 8:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(found)


def test_base_spans(spark):
    rows = [(i, t, None) for i, t in enumerate(TEXTS)] + [(1, "", None), (None, TEXTS[4], None)]
    got = secrets.scan_secrets(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain_base((TEXTS[4] if r.doc_id is None else TEXTS[r.doc_id]) or "")
        text = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w[1] == k for w in want) for k in range(3)]
        assert [x for x in r.spans.split(",") if x and not x.startswith("novel")] == [x for x in text.split(",") if x]


def test_novel_spans_need_an_incompressible_string(spark):
    got = {r.doc_id: r for r in secrets.scan_secrets(frame(spark, [(i, TEXTS[i], None) for i in (13, 14)])).collect()}
    assert got[13].spans == "novel:10:30" and got[14].spans == ""


def plain_novel(text, base, threshold):
    """The rule over all places: the first long run of key characters within reach of a word, whole, off the base spans."""
    words = [m.end() for m in re.finditer("(?ai:" + "|".join(secrets._SENSITIVE) + ")", text)]
    found = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", text):
        # A word inside a run lets the rest of it count, if that is long enough.
        starts = [max(m.start(), w) for w in words if w <= m.start() <= w + secrets.REACH or m.start() < w <= m.end() - 16]
        for start in sorted(starts)[:1]:
            if any(s < m.end() and start < e for s, e, _ in base):
                continue
            around = text[max(0, start - secrets.AROUND):start] + text[m.end():m.end() + secrets.AROUND]
            if secrets.novelty(text[start:m.end()], around) >= threshold:
                found.append((start, m.end(), "novel"))
    return found


def test_novel_spans_equal_a_plain_search():
    dice = random.Random(17)
    alphabet = string.ascii_letters + string.digits
    for _ in range(150):
        parts = []
        for _ in range(dice.randrange(1, 25)):
            parts.append(dice.choice([
                "".join(dice.choices(alphabet, k=dice.choice([10, 16, 20, 40, 90]))), "auth ", "the key ", "bearer: ", "word and more words. ", " " * dice.choice([1, 30, 60]), "\n",
                "password = " + "".join(dice.choices(alphabet, k=9)) + " ", "deadbeef" * 4 + " ", "configurationManagerService ", "AKIA" + "Z9" * 8 + " "]))
            parts.append(" ")
        text = "".join(parts)
        base = secrets.base_spans(text)
        assert secrets.novel_spans(text, base, 0.9) == plain_novel(text, base, 0.9), text


def test_a_text_of_many_spans_takes_linear_time():
    text = "token: abcdefgh12 " * 100_000
    start = time.perf_counter()
    base = secrets.base_spans(text)
    assert len(base) == 100_000 and secrets.novel_spans(text, base, 0.9) == []
    assert time.perf_counter() - start < 10


def test_random_letters_are_lost_rarely_and_names_hardly_ever_reported():
    dice = random.Random(8)
    keys = ["".join(dice.choices(string.ascii_lowercase, k=16)) for _ in range(400)]
    assert sum(secrets.novelty(k, "the auth header of a request") >= 0.9 for k in keys) >= 0.98 * len(keys)
    names = ["getAuthenticationTokenProvider", "passwordResetConfirmation", "configurationManagerService", "internationalization", "refreshTokenRepository", "HttpServletRequestWrapper"]
    assert not [n for n in names if secrets.novelty(n, "the auth header of a request") >= 0.9]


def test_novelty_falls_when_the_text_around_repeats_the_string():
    key = "Zk9vQ2xT7mB4wR1yH6nD"
    assert secrets.novelty(key, "") > 0.9 > secrets.novelty(key, f"before {key} behind")


@pytest.mark.parametrize("alphabet", ["0123456789", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", string.ascii_letters,
                                      string.ascii_letters + string.digits + "+/"])
@pytest.mark.parametrize("length", [48, 64, 128, 200, 512, 5000])
def test_random_keys_are_novel_whatever_their_length_and_alphabet(alphabet, length):
    dice = random.Random(length)
    for _ in range(4):
        text = f"auth uses {''.join(dice.choices(alphabet, k=length))} as given"
        assert secrets.novel_spans(text, [], 0.9) == [(10, 10 + length, "novel")]


@pytest.mark.parametrize("gap", [0, 24, 40, 46])
def test_candidates_start_anywhere_in_reach(gap):
    key = "Zk9vQ2xT7mB4wR1yH6nD"
    text = "auth " + "." * gap + " " + key + " end"
    assert secrets.novel_spans(text, [], 0.9) == [(6 + gap, 26 + gap, "novel")]
    assert secrets.novel_spans("auth " + "." * 48 + " " + key, [], 0.9) == []


def test_keys_without_digits_are_told_from_words():
    dice = random.Random(4)
    keys = ["".join(dice.choices(a, k=n)) for a in (string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters) for n in (24, 32, 64) for _ in range(5)]
    assert all(secrets.novel_spans(f"bearer {key} x", [], 0.9) == [(7, 7 + len(key), "novel")] for key in keys)
    for word in ("responsibilities", "Donaudampfschifffahrtsgesellschaft", "DATABASE_CONNECTION_TIMEOUT", "anticonstitutionnellement", "=" * 40):
        assert secrets.novel_spans(f"auth of {word} here", [], 0.9) == []


def test_language(spark):
    words = {"en": "the house and the river with many old stones", "fr": "la maison et le fleuve avec beaucoup de pierres",
             "de": "das haus und der fluss mit vielen alten steinen"}
    dice = random.Random(3)
    rows = [(i, " ".join(dice.choices(words[g].split(), k=12)), g) for i in range(90) for g in [("en", "fr", "de")[i % 3]]]
    model = language_id.train(frame(spark, [*rows, (900, None, "en"), (901, "text", None)]))
    assert model.languages == ("de", "en", "fr")
    tests = [(1, "the old river", "fr"), (2, "le fleuve", None), (3, None, "en"), (4, "12 !?", "en"), (5, "", "en"), (6, "ж", None), (7, LONG, None),
             (8, "der fluss und das haus", "en"), (8, "der fluss und das haus", "en"), (9, "𝒳", None)]
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in language_id.identify(frame(spark, tests), model).collect())
    assert [(i, g) for i, g, _ in got] == [(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (6, "de"), (7, got[6][1]), (8, "de"), (8, "de"), (9, "de")]
    assert all(0 <= s <= 1 for _, _, s in got)
    # The counts of a filter without false positives are those of sets of n-grams.
    sets = {g: set() for g in words}
    for _, text, g in rows:
        sets[g] |= set(language_id.grams(text, (4,)).tolist())
    mine = language_id.grams("the old river and le fleuve", (4,)).tolist()
    hits = {g: sum(x in s for x in mine) for g, s in sets.items()}
    lang, score = model.decide("the old river and le fleuve")
    assert lang == "en" and score == pytest.approx(hits["en"] / sum(hits.values()), abs=1e-3)


def test_language_without_training_rows(spark):
    model = language_id.train(frame(spark, [(1, "text", None)]))
    assert [(r.lang_pred, r.score) for r in language_id.identify(frame(spark, [(1, "text", "en")]), model).collect()] == [("und", 0.0)]


def test_many_languages_use_further_slices(spark):
    rows = [(i, f"{chr(0x4E00 + 5 * i) * 3}{chr(0x4E01 + 5 * i) * 3}", f"l{i:03}") for i in range(130)]
    model = language_id.train(frame(spark, rows))
    assert model.masks.shape[0] == 3
    assert {r.doc_id: r.lang_pred for r in language_id.identify(frame(spark, rows), model).collect()} == {i: g for i, _, g in rows}


def test_exact_dedup(spark):
    dice = random.Random(5)
    rows = [(i, dice.choice(["a", "A", "a ", "", None, "b" * 70_000, f"own {i}"]), None) for i in range(200)] + [(7, "same row", None), (7, "same row", None), (None, "a", None)]
    index = exact_dedup.DigestIndex.open(spark, shared_path(spark, "index"), 4)
    got = exact_dedup.deduplicate(frame(spark, rows), index).collect()
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    want = {(i, t or "") for i, t, _ in rows}
    assert len(got) == len(want)
    by_digest = {hashlib.sha256(t.encode()).digest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_digest[bytes(r.digest)]
        keep = max(i for i in ids if i is not None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)
    stay = exact_dedup.drop_copies(frame(spark, rows), exact_dedup.DigestIndex.open(spark, shared_path(spark, "index"), 4))
    assert stay.columns == frame(spark, rows[:1]).columns
    assert sorted(t or "" for t in (r.text for r in stay.collect())) == sorted(groups)


def test_nothing_is_left_behind(spark):
    folder = "/root/testdata/sf0.001"
    place = checkpoint_folder(spark).removeprefix("file:")
    before, tables = set(os.listdir(place)), {t.name for t in spark.catalog.listTables()}
    with scratch(spark):
        found = op8_exact_dedup(spark, folder).collect()
        assert set(os.listdir(place)) > before
    assert len(found) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert set(os.listdir(place)) == before and {t.name for t in spark.catalog.listTables()} == tables


def test_index_persists(spark):
    path = shared_path(spark, "index")
    first = exact_dedup.deduplicate(frame(spark, [(1, "a", None), (2, "b", None)]), exact_dedup.DigestIndex.open(spark, path, 4))
    assert all(r.kept for r in first.collect())
    again = exact_dedup.DigestIndex.open(spark, path, 4)
    second = exact_dedup.deduplicate(frame(spark, [(9, "a", None), (8, "c", None)]), again)
    assert {r.doc_id: (r.keep_id, r.kept) for r in second.collect()} == {9: (1, False), 8: (8, True)}
    assert again.read().count() == 3
    batch = exact_dedup.text_digests(frame(spark, [(9, "a", None)])).groupBy("digest").agg(F.max("doc_id"))
    plan = batch.join(again.read().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("hashpartitioning") == 1


def test_packing(spark):
    dice = random.Random(9)
    odd = ["", None, "naïve  café\n\n  x", "<|endoftext|> a", "𝒳🙂 " * 50, "a" * 3000, LONG, "  \t\n ", "don't I'll 12345"]
    rows = [(i, t, None) for i, t in enumerate(odd)] + [(100 + i, " ".join(dice.choices(["alpha", "beta", "x9", "Ünder"], k=dice.randrange(1, 900))), None) for i in range(300)] + [(100, "again", None)]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t, _ in rows:
        want.setdefault(i, []).append([*plain.encode(t or "", add_special_tokens=False).ids, 1])
    got = packing.pack(frame(spark, rows), TOKENIZER).collect()
    sequences, pieces = {}, {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    fills = [sum(n for _, n in parts) for parts in sequences.values()]
    assert all(f == 2048 or f & (f - 1) == 0 for f in fills)
    assert sorted(pieces) == sorted(want)
    for i, ids in want.items():
        if len(ids) == 1:
            at = 0
            for r in sorted(pieces[i], key=lambda r: r.start):
                part = ids[0][at:at + r.length]
                assert r.start == at and r.doc_tokens == len(ids[0])
                assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
                at += r.length
            assert at == len(ids[0])


def test_placement_is_the_least_sum_of_squares():
    dice = random.Random(1)
    packer, counts = packing.LevelPacker(20), [0] * 21
    for k in range(400):
        n = dice.randrange(1, 21)
        best = None
        for level in [0] + [h for h in range(1, 21 - n) if counts[h]]:
            after = counts.copy()
            if level:
                after[level] -= 1
            if level + n < 20:
                after[level + n] += 1
            cost = sum(c * c for c in after[1:20])
            if best is None or (cost, -level) < best[:2]:
                best = (cost, -level, after)
        packer.place((k, 0, list(range(n))))
        counts = best[2] if n < 20 else counts
        assert packer.counts[1:20].tolist() == counts[1:20]


@pytest.mark.parametrize("name", ["secrets", "language", "dedup", "packing"])
def test_empty_table(spark, name):
    empty = spark.createDataFrame([], SCHEMA)
    rows = {
        "secrets": lambda: secrets.scan_secrets(empty),
        "language": lambda: language_id.identify(empty, language_id.train(empty)),
        "dedup": lambda: exact_dedup.deduplicate(empty, exact_dedup.DigestIndex.open(spark, shared_path(spark, "index"), 4)),
        "packing": lambda: packing.pack(empty, TOKENIZER),
    }[name]()
    assert rows.collect() == []


def test_op8_is_registered(spark):
    assert op8_exact_dedup(spark, "/root/testdata/sf0.001").count() == 200
