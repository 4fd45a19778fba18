from __future__ import annotations

import base64
import collections
import gzip
import math
import re
import zlib

import numpy as np
import pytest

from econspark.llm import _words, license_scan, near_dedup, packing, piece_codec, secret_scan, tokeniser_quality
from econspark.llm.queries import vocabulary
from econspark.session import ensure_checkpoint_dir
from tests.llm.cases import awkward_documents
from tests.llm.prose import PROSE

SPACE = "[^\x20\x09-\x0d]+"


@pytest.fixture(scope="module")
def docs(spark):
    return awkward_documents(spark).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


# quality rules


def judged(df):
    return tokeniser_quality.add_quality(df, vocabulary("piece_bpe_32k.model"), vocabulary("word_bpe_49k.json"))


def test_quality_against_brute_force(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    rows = judged(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        q, text = r["quality"], r["text"] or ""
        words = re.findall(SPACE, text)
        lines = [x for x in text.split("\n") if re.search(SPACE, x)]
        windows = collections.Counter(zip(words, words[1:], words[2:]))
        again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        want = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == want
        assert q["base_failed"] == (len(words) < 50 or 100 * len(again) > 50 * len(words))
        assert not (q["base_failed"] and q["kept"])
        if words:
            ids = [i for w in words for i in model.encode(w)]
            share = np.array(list(collections.Counter(ids).values())) / len(ids)
            assert q["chars_per_token"] == pytest.approx(sum(map(len, words)) / len(ids))
            assert q["entropy"] == pytest.approx(-(share * np.log2(share)).sum(), abs=1e-9)
            assert q["byte_share"] == pytest.approx(sum(3 <= i < 259 for i in ids) / len(ids))


def test_quality_bands_and_scripts(spark, none):
    assert tokeniser_quality.main_script("где я") == "cyrillic"
    assert tokeniser_quality.main_script("漢字 a") == "han"
    assert tokeniser_quality.main_script("12 ...") == "other"
    text = " ".join(f"w{i} {'x' * (i % 7)}" for i in range(100))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    strict = {"latin": tokeniser_quality.Band((50.0, 60.0)), "other": tokeniser_quality.Band()}
    r = tokeniser_quality.add_quality(df, vocabulary("piece_bpe_32k.model"), bands=strict, lang=None).first()["quality"]
    assert not r["kept"] and "chars_per_token" in r["reasons"]
    assert judged(none).count() == 0


@pytest.fixture(scope="module")
def measured():
    encoders = tokeniser_quality.piece_encoder(vocabulary("piece_bpe_32k.model"))(), packing.word_encoder(vocabulary("word_bpe_49k.json"))()
    table = _words.WordTable(*encoders)
    return lambda text, lang: tokeniser_quality._measure(text.encode(), lang, table, table.rows([text.encode()])[0], tokeniser_quality.BANDS)


@pytest.mark.parametrize("lang", PROSE)
def test_clean_prose_is_kept(measured, lang):
    words = PROSE[lang].split()
    for n in range(50, len(words) + 1):
        for given in (lang, None):
            assert measured(" ".join(words[:n]), given)["reasons"] == "", (lang, n)


def test_poor_texts_are_rejected_still(measured):
    rng = np.random.default_rng(2)
    for letters in ("abc", "αβγ", "абв", "漢字", "ابج", "0123456789", "#$%"):
        text = " ".join("".join(rng.choice(list(letters), 6)) for _ in range(300))
        assert "entropy" in measured(text, None)["reasons"], letters


def test_repeated_words_with_many_rows():
    small = np.array([1, 2, 3, 4, 1, 2, 3, 9])
    assert tokeniser_quality.repeated_words(small) == 6
    assert tokeniser_quality.repeated_words(small + (1 << 22)) == 6


# words


def test_words_equal_split():
    texts = [b"", b" a  b\n", "é ü x".encode(), b"a" * 10, b" ", (b"long word " * 400_000)]
    hasher = _words.WordHasher()
    seen: dict = {}
    for data, hashes, start, end, _ in hasher.of_texts(texts):
        for h, a, b in zip(hashes.tolist(), start.tolist(), end.tolist()):
            assert seen.setdefault(h, data[a:b]) == data[a:b]
    counts = [len(x) for x in hasher.split(texts, lambda d, h, s, e: h)]
    assert counts == [len(t.split()) for t in texts]


def test_table_starts_afresh(monkeypatch):
    monkeypatch.setattr(_words, "TABLE_WORDS", 10)
    encode = lambda words: (np.array([int(w) for w in words], np.int32), np.ones(len(words), np.int32))
    table = _words.WordTable(encode)
    for i in range(50):
        text = b" ".join(b"%d" % n for n in range(i, i + 30))
        assert table.gather(table.rows([text])[0]).tolist() == list(range(i, i + 30))


# near duplicates


def brute_classes(texts: list) -> list[int]:
    sets = []
    for t in texts:
        w = re.findall(SPACE, t or "")
        sets.append(collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter())
    n = sum(t is not None for t in texts)
    df = collections.Counter(s for x in sets for s in x)
    idf = lambda s: 1 + math.log(min(n / df[s], near_dedup.TAU)) / math.log(near_dedup.TAU) if df[s] > n // near_dedup.TAU else 2.0
    weights = [{s: c * idf(s) for s, c in x.items()} for x in sets]
    top = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = weights[i], weights[j]
            low = sum(min(v, b[s]) for s, v in a.items() if s in b)
            total = sum(a.values()) + sum(b.values()) - low
            if texts[i] is not None and texts[i] == texts[j] or total and low / total >= 0.8:
                x, y = top[i], top[j]
                top = [min(x, y) if t in (x, y) else t for t in top]
    return top


def test_near_duplicates_against_brute_force(docs, none):
    given = docs.select("doc_id", "text").collect()
    top = brute_classes([r["text"] for r in given])
    want = []
    for i, r in enumerate(given):
        ids = [given[j]["doc_id"] for j in range(len(given)) if top[j] == top[i] and given[j]["doc_id"] is not None]
        want.append((r["doc_id"], r["doc_id"] if r["text"] is None else min(ids, default=None)))
    key = lambda x: [(v is None, v or 0) for v in x]
    got = [tuple(r) for r in near_dedup.near_duplicates(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert near_dedup.near_duplicates(none).count() == 0


def test_one_row_of_each_class(docs):
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    texts = [r["text"] for r in rows if r["text"] is not None]
    assert sum(r["text"] is None for r in rows) == 2
    given = [r["text"] for r in docs.collect()]
    assert len(texts) == len({t for t, x in zip(brute_classes(given), given) if x is not None})
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] in (1, 2, 3)) == [1]


def test_large_group_and_dissimilar_bucket(spark):
    """A large group of copies and near copies, and texts whose bucket holds unlike texts."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words)) for i in range(300)]
    for i in range(300, 500):
        rows.append((i, " ".join([*words[: i % 190], f"new{i}", *words[i % 190 + 1 :]])))
    rows += [(1000 + i, " ".join([*words[:60], *[f"own{i}-{k}" for k in range(90)]])) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert all(got[i] == 0 for i in range(500))
    assert all(got[1000 + i] == 1000 + i for i in range(100))


def test_blocks_find_what_the_pivot_misses(spark):
    """A chain in which the ends are unlike: every link counts."""
    words = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join([*[f"x{i}" for i in range(12 * k)], *words[12 * k :]])) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(near_dedup.near_duplicates(df).collect())
    top = brute_classes([t for _, t in rows])
    assert [got[i] for i in range(len(rows))] == top


def test_sampling_estimates_weighted_jaccard():
    kernel, rng = near_dedup.Kernel(), np.random.default_rng(3)
    hashes = np.sort(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    one, two = hashes[:300], hashes[80:]
    wa, wb = rng.uniform(1, 6, 300), rng.uniform(1, 6, 320)
    wb[:220] = wa[80:] * rng.uniform(0.7, 1.4, 220)
    agree = []
    for salt in range(60):
        x = near_dedup.mix(hashes + np.uint64(salt * 7919))
        order_a, order_b = np.argsort(x[:300]), np.argsort(x[80:])
        both = np.concatenate((x[:300][order_a], x[80:][order_b])), np.concatenate((wa[order_a], wb[order_b]))
        keys = kernel.sample(*both, np.array([0, 300]))[1]
        agree.append((keys[:, 0] == keys[:, 1]).mean())
    assert np.mean(agree) == pytest.approx(near_dedup.jaccard((one, wa), (two, wb)), abs=0.03)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(bytearray([i]), bytearray([i + 1])) for i in range(40)] + [(bytearray([90]), bytearray([91]))], "a binary, b binary")
    got = {bytes(r["node"])[0]: bytes(r["comp"])[0] for r in near_dedup.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 91: 90}


def test_components_find_the_links_once(spark):
    given = spark.sparkContext.accumulator(0)

    def found(batches):
        for batch in batches:
            given.add(batch.num_rows)
            yield batch

    links = spark.createDataFrame([(bytearray([i]), bytearray([i + 1])) for i in range(0, 40, 2)], "a binary, b binary").mapInArrow(found, "a binary, b binary")
    assert near_dedup.components(links).count() == 40
    assert given.value == 20


def test_tables_have_few_files(spark):
    """Each file costs processes on the executors, so their number must not follow tables times shuffle partitions."""
    from pathlib import Path

    kept = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    old, names = set(kept.iterdir()), ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    were = [spark.conf.get(k) for k in names]
    rows = [(i, " ".join([*[f"f{i // 2}-{k}" for k in range(60)], f"own{i}"])) for i in range(400)]
    try:
        for k, v in zip(names, ("48", "false"), strict=True):
            spark.conf.set(k, v)
        df = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
        got, n = dict(df.collect()), df.rdd.getNumPartitions()
    finally:
        for k, v in zip(names, were, strict=True):
            spark.conf.set(k, v)
    assert got == {i: i - i % 2 for i in range(400)}
    files = {p.name.partition("-")[0]: len(list(p.glob("part-*"))) for p in set(kept.iterdir()) - old}
    assert {"signed", "placed", "members", "edges", "labels", "known"} <= set(files)
    assert max(n, *(v for k, v in files.items() if k != "texts")) <= 2 * spark.sparkContext.defaultParallelism


# licenses


def test_licenses_against_brute_force(docs, spark, none):
    texts = [
        "X Under the MIT License, under the mit license; apache license version 2.0", "cc-by-nc cc by  nc", "mit license the under", None, "",
        "a " * 61 + "under the mit license" + " b" * 70, "word " * 30 + license_scan.NOTICES[0].text + " word" * 40, "under the\nmit é license under the mit license",
    ]
    df = docs.select("text").union(spark.createDataFrame([(t,) for t in texts], "text string"))
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for r in license_scan.scan_licenses(df).collect():
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (r["text"] or "").translate(lower))
        want = sorted((i, t.label) for t in license_scan.BASE for i in range(len(words)) if words[i : i + len(t.words)] == [w.decode() for w in t.words])
        assert r["licenses"]["n_words"] == len(words)
        assert sorted((m["start"], m["label"]) for m in r["licenses"]["matches"] if m["exact"]) == want
        stride, width = license_scan.STRIDE, license_scan.STRIDE + max(len(t.words) for t in license_scan.BASE + license_scan.NOTICES) - 1
        near = set()
        for t in license_scan.NOTICES:
            need = {w.decode() for w in t.words}
            near |= {(b, t.label) for b in range(0, len(words), stride) if len(need & set(words[b : b + width])) >= license_scan.THRESHOLD * len(need)}
        assert {(m["start"], m["label"]) for m in r["licenses"]["matches"] if not m["exact"]} == near
    assert license_scan.scan_licenses(none).count() == 0


# packing


def test_packing_is_whole_and_without_gaps(docs, none):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, length=256, open_windows=3).collect()
    coded = lambda t: (*tokenizer.encode(t or "", add_special_tokens=False).ids, 1)
    want = collections.Counter((r["doc_id"], coded(r["text"])) for r in docs.collect())
    lengths = collections.Counter()
    for _, pieces in _grouped(rows, "sequence_id"):
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at and len(p["ids"]) == 4 * p["length"] and zlib.crc32(p["ids"]) == p["ids_crc32"]
            at += p["length"]
        lengths[at] += 1
    assert all(n & (n - 1) == 0 and n <= 256 for n in lengths)
    assert lengths[256] == sum(len(ids) * n for (_, ids), n in want.items()) // 256
    by_doc = collections.defaultdict(collections.Counter)
    for p in rows:
        by_doc[p["doc_id"]].update(np.frombuffer(p["ids"], "<u4").tolist())
    assert by_doc == {d: sum((collections.Counter(dict(collections.Counter(ids).items())) for (x, ids), n in want.items() for _ in range(n) if x == d), collections.Counter()) for d, _ in want}
    assert packing.pack(none, path).count() == 0


def _grouped(rows, key):
    found = collections.defaultdict(list)
    for r in rows:
        found[r[key]].append(r)
    return found.items()


def test_words_encode_like_the_whole_text():
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    table = _words.WordTable(packing.word_encoder(path)(), hasher=_words.WordHasher(packing.MARKS))
    texts = ["It's John's. été ÉA ΣΣ ok... <|endoftext|> a<|startoftext|>b. x,y! 12. ªµ", "a b c 你好，!. İx", "", "...", "A" * 3000 + ". b"]
    for t, rows in zip(texts, table.rows([t.encode() for t in texts])):
        assert table.gather(rows).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


# secrets


def test_secrets_in_layers():
    plain = "api_key = 'abcdefgh1234'"
    b64 = base64.b64encode(plain.encode()).decode()
    twice = base64.b64encode(b64.encode()).decode()
    packed = base64.b64encode(gzip.compress(plain.encode())).decode()
    url = "".join(f"%{b:02x}" for b in plain.encode())
    escaped = "".join(f"\\u{ord(c):04x}" for c in plain)
    for hidden, path in ((b64, "base64"), (twice, "base64>base64"), (packed, "base64>compressed"), (url, "url"), (escaped, "unicode"), (base64.b64encode(url.encode()).decode(), "base64>url")):
        text = f"é see {hidden} end"
        found = [s for s in secret_scan.find_secrets(text) if "~" in s[0]]
        assert [k for k, _, _ in found] == [f"assign~{path}"], (hidden, found)
        assert 6 <= found[0][1] < found[0][2] <= 6 + len(hidden)
    assert secret_scan.find_secrets(f"x {url}")[0][1:] == (2, 2 + len(url) - 3)  # the closing quote is not part of the find


def test_same_encoded_secret_at_three_places(spark):
    plain = b"api_key = 'abcdefgh1234'"
    b64 = base64.b64encode(plain).decode()
    packed = base64.b64encode(gzip.compress(plain)).decode()
    url = "".join(f"%{b:02x}" for b in plain)
    escaped = "".join(f"\\u{b:04x}" for b in plain)
    for hidden in (b64, packed, url, escaped, base64.b64encode(b64.encode()).decode()):
        text = f"{hidden} one {hidden}, two {hidden} end"
        at = [m.start() for m in re.finditer(re.escape(hidden), text)]
        found = secret_scan.find_secrets(text)
        assert len(found) == 3 and len({k for k, _, _ in found}) == 1
        assert all(i <= a < b <= i + len(hidden) for i, (_, a, b) in zip(at, found, strict=True))
        clean = secret_scan.redact(spark.createDataFrame([(text,)], "text string")).first()["text"]
        assert clean.count("[SECRET]") == 3 and hidden not in clean


def test_secrets_in_layers_that_are_not_clean_text():
    text = "é q=caf%E9&password%3Dhunter2hunter2 end"
    (found,) = secret_scan.find_secrets(text)
    assert found[0] == "assign~url" and text[found[1] : found[2]] == "password%3Dhunter2hunter2"
    for raw in ("café token=abcdefgh1234 é".encode("latin-1"), b"\0\x01 token=abcdefgh1234\0 \x7f", "é漢😀 token=abcdefgh1234".encode() + b"\xff"):
        plain, packed = base64.b64encode(raw).decode(), base64.b64encode(gzip.compress(raw)).decode()
        (found,) = secret_scan.find_secrets(f"é {plain} end")
        at = raw.index(b"token")
        assert found == ("assign~base64", 2 + at * 4 // 3, 2 - (-(at + 18) * 4 // 3))
        assert secret_scan.find_secrets(f"é {packed} end") == [("assign~base64>compressed", 2, 2 + len(packed))]


def test_base64_runs_of_any_length_joined_and_wrapped():
    assert secret_scan.find_secrets("dG9rZW49YWJjZGVmZ2g=") == [("assign~base64", 0, 19)]
    plain = b"token=abcdefgh1234 and more"
    b64 = base64.b64encode(plain).decode()
    for before in ("/cb/", "/c/", "key-", "a_", "ab/c", "x"):
        for after in ("", "A", "AB", "ABC"):
            (found,) = secret_scan.find_secrets(f"é {before}{b64}{after} end")
            assert found == ("assign~base64", 2 + len(before), 2 + len(before) + 24)
    long = b"".join(b"word%d " % i for i in range(30)) + plain
    packed = gzip.compress(b"".join(bytes([33 + i * i % 90]) for i in range(300)) + b" " + plain)
    for columns in (16, 64, 76):
        for gap in ("\n", "\r\n", "\n  "):
            wrapped = lambda b: gap.join(re.findall(f".{{1,{columns}}}", base64.b64encode(b).decode()))
            for k in range(12):  # the secret at every place of a line
                text = f"é: {wrapped(long[k:])}"
                (found,) = [f for f in secret_scan.find_secrets(text)]
                at = long[k:].index(b"token")
                bare = re.sub(r"\s", "", text[: found[1]]), re.sub(r"\s", "", text[: found[2]])
                assert found[0] == "assign~base64" and (len(bare[0]), len(bare[1])) == (2 + at * 4 // 3, 2 - (-(at + 18) * 4 // 3))
            text = f"é: {wrapped(packed)}"
            assert secret_scan.find_secrets(text) == [("assign~base64>compressed", 3, len(text))]
            text = f"é:\n/cb/{wrapped(packed)}"
            assert ("assign~base64>compressed", 7, len(text)) in secret_scan.find_secrets(text)


def test_large_manifold_and_cut_streams(spark):
    secret = b" token=abcdefgh1234 "
    many = gzip.compress(b"one ") + gzip.compress(b"two") + gzip.compress(secret) + b"\0" * 5 + zlib.compress(b" password=hunter2hunter2 ")
    text = base64.b64encode(many).decode()
    assert {k for k, _, _ in secret_scan.find_secrets(text)} == {"assign~base64>compressed"}
    assert len(secret_scan.find_secrets(text)) == 2
    rng = np.random.default_rng(1)
    noise = rng.integers(33, 127, 3000).astype(np.uint8).tobytes()
    cut = base64.b64encode(zlib.compress(secret + noise)[:-200]).decode()
    assert secret_scan.find_secrets(cut) == [("assign~base64>compressed", 0, len(cut))]
    filler = b"some plain words here. " * ((secret_scan.MOST_UNFOLDED + secret_scan.WINDOW) // 23)
    clean = base64.b64encode(gzip.compress(filler)).decode()
    assert [k for k, _, _ in secret_scan.find_secrets(clean)] == ["too-large~base64>compressed"]
    hidden = base64.b64encode(gzip.compress(filler + base64.b64encode(gzip.compress(secret)) + b" end")).decode()
    assert [k for k, _, _ in secret_scan.find_secrets(hidden)] == ["assign~base64>compressed>base64>compressed", "too-large~base64>compressed"]
    rows = secret_scan.redact(spark.createDataFrame([(1, f"a {clean} b"), (2, f"a {hidden} b")], "id int, text string")).collect()
    assert {r["id"]: r["text"] for r in rows} == {1: f"a {clean} b", 2: "a [SECRET] b"}


def test_windows_cut_no_run():
    run = b"A" * (secret_scan.WINDOW * 2)
    pieces = [(b"word " * (secret_scan.WINDOW // 4), 0, False), (run, 0, False), (b" word" * secret_scan.WINDOW, 0, False)]
    windows = list(secret_scan._windows(iter(pieces)))
    assert any(run in w for w in windows) and max(map(len, windows)) < 8 * secret_scan.WINDOW


def test_secret_layers_end():
    bomb = lambda letter: base64.b64encode(zlib.compress(letter * (secret_scan.MOST_UNFOLDED + 10))).decode()
    kinds = lambda text: [k for k, _, _ in secret_scan.find_secrets(text)]
    assert kinds(bomb(b"z")) == ["too-large~base64>compressed"]
    assert kinds(bomb(b"a")) == ["hex~base64>compressed", "too-large~base64>compressed"]
    assert secret_scan.find_secrets("%25" * 500 + " " + "%2525") == []


def test_secret_base_and_redaction(spark, docs, none):
    key = "AKIA" + "A1" * 8
    text = f'Password: "hunter2hunter2" token=short TOKEN=abcdefgh {key} {"0f" * 20} ſecret=abcdefghij'
    found = secret_scan.find_secrets(text)
    assert [(k, text[a:b]) for k, a, b in found] == [("assign", 'Password: "hunter2hunter2'), ("assign", "TOKEN=abcdefgh"), ("access", key), ("hex", "0f" * 20)]
    df = docs.select("doc_id", "text", "secrets").union(spark.createDataFrame([(99, text, 1)], "doc_id long, text string, secrets int"))
    clean = {r["text"] for r in secret_scan.redact(df).collect()}
    assert f'[SECRET]" token=short [SECRET] [SECRET] [SECRET] ſecret=abcdefghij' in clean and None in clean and "" in clean
    assert secret_scan.scan_secrets(df).where("size(secrets.spans) > 0").count() == 1
    assert secret_scan.redact(none).count() == 0


# pieces


def test_pieces_round_trip_and_scores(docs, none):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    coded = piece_codec.decode_pieces(piece_codec.encode_pieces(docs.select("doc_id", "text", "word"), path), path).collect()
    assert len(coded) == docs.count()
    for r in coded:
        assert r["decoded"] == r["text"] and (r["pieces"] is None) == (r["text"] is None)
    codec = piece_codec.Codec(path)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    likely = lambda i: -math.log(piece_codec.RANK_OFFSET - model.get_score(i)) if model.get_score(i) > -1e8 else -math.inf
    score = {model.id_to_piece(i): likely(i) for i in range(259, model.vocab_size()) if model.get_score(i) > -1e8}
    for unit in ("hello", " hello", " Ænigma①x", " aaaaaaaaaaaaa", "é" * 100):
        text, best = unit.replace(" ", "▁"), [0.0]
        for e in range(1, len(text) + 1):
            best.append(max(best[s] + score.get(text[s:e], codec.unknown if e - s == 1 else -math.inf) for s in range(max(0, e - 16), e)))
        ids, _ = codec.encode([unit.encode()])
        got = 0.0
        for i in ids.tolist():
            value = np.flatnonzero(codec.byte_id == i)
            if len(value):
                got += codec.unknown if int(value[0]) & 0xC0 != 0x80 else 0.0  # once per character
            else:
                got += max(likely(i), codec.unknown)
        assert got == pytest.approx(best[-1]), unit
    assert piece_codec.encode_pieces(none, path).count() == 0


def test_pieces_of_special_texts():
    path = vocabulary("piece_bpe_32k.model")
    codec = piece_codec.Codec(path)
    table = _words.WordTable(codec.encode, hasher=_words.UnitHasher())
    texts = ["", " ", "  a  b ", "\n\n", "x\ny \n", "a▁b ▁", "\x00\t", "😀" * 70, "no blank" * 30_000, "z" * 9_000]
    for t, rows in zip(texts, table.rows([t.encode() for t in texts])):
        assert codec.decode(table.gather(rows).tolist()) == t


def test_pieces_are_near_the_models_own(spark):
    """Every document's ids against a plain search over whole units, and their number against the model's merge order."""
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text IS NOT NULL")
    rows = piece_codec.encode_pieces(docs.select("doc_id", "text"), path).select("text", "pieces").collect()
    own = sum(len(model.encode(r["text"])) for r in rows)
    assert abs(sum(len(r["pieces"]) for r in rows) / own - 1) < 0.01
    codec = piece_codec.Codec(path)
    likely = {model.id_to_piece(i): (-math.log(piece_codec.RANK_OFFSET - model.get_score(i)), i) for i in range(259, model.vocab_size()) if model.get_score(i) > -1e8}

    single = {model.id_to_piece(i): i for i in range(259, model.vocab_size()) if len(model.id_to_piece(i)) == 1}

    def plain(unit: str) -> list[int]:
        text, best = unit.replace(" ", "▁"), [(0.0, [])]
        for e in range(1, len(text) + 1):
            ways = []
            for s in range(max(0, e - codec.longest), e):  # the longer last piece first
                if text[s:e] in likely and (likely[text[s:e]][0] > codec.unknown):
                    value, i = likely[text[s:e]]
                    ways.append((best[s][0] + value, [*best[s][1], i]))
                elif e - s == 1:
                    ids = [single[text[s]]] if text[s] in single else [int(codec.byte_id[b]) for b in unit[s].encode()]
                    ways.append((best[s][0] + codec.unknown, [*best[s][1], *ids]))
            best.append(max(ways, key=lambda w: w[0]))
        return best[-1][1]

    known: dict[str, list[int]] = {}
    for r in rows:
        units = re.findall(r" [^ \n]*|\n|[^ \n]+", " " + r["text"]) if r["text"] else []
        assert r["pieces"] == [i for u in units for i in (known.get(u) or known.setdefault(u, plain(u)))]
