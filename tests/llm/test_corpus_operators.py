"""Each operator against a plain version, on texts with all the odd cases."""

import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from repoweave.llm import decontaminate, fingerprint, language, license, license_rules, linedup, minhash, packing, pii, sharding, urlfilter
from repoweave.llm.common import among, collected, meeting

LOW = {c: c + 32 for c in range(65, 91)}
KIND = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, k string, o double, row int, label string, fingerprint string, nothing void"


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


@pytest.fixture(scope="module")
def texts():
    """doc_id -> text: words, copies, near copies, chains of edits, shared passages, nulls, blanks, one long text."""
    chance = random.Random(5)
    words = ["".join(chance.choice("abcdefgh") for _ in range(chance.randint(2, 6))) for _ in range(600)]
    line = lambda n: " ".join(chance.choice(words) for _ in range(n))
    out = {}
    passage = line(60)
    for i in range(60):
        out[i] = "\n".join(line(chance.randint(1, 40)) for _ in range(chance.randint(1, 6)))
    for i in range(60, 70):
        out[i] = out[3]
    base = line(150).split()
    for i in range(70, 110):  # each an edit of another of the group
        out[i] = " ".join(base)
        if i > 70:
            w = out[chance.randint(70, i - 1)].split()
            w[chance.randrange(len(w))] = chance.choice(words)
            out[i] = " ".join(w)
    for i in range(110, 120):
        out[i] = f"{line(20)}\n{passage}\n{line(5)}"
    out |= {120: None, 121: "", 122: " \n\t ", 123: "one two", 124: "One two", 125: "Zoë CAFÉ été", 126: "\n".join(line(30) for _ in range(3000))}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    """The texts as documents: with a null id, repeated rows, and extra columns whose names operators use too."""
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 4}", len(t or "")) for i, t in texts.items()]
    rows += [(None, "no id here at all", "en", None, None), (5, texts[5], None, None, None)]
    return spark.createDataFrame([(*r, True, "x", 1.5, 1, "y", "z", None) for r in rows], KIND).repartition(3).cache()


def by_id(df, texts):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def components(sets, num, den):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("num", "block"), [(85, 256), (80, 4)])
def test_near_duplicates_against_all_pairs(docs, texts, num, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    words = {i: spaced(t) for i, t in texts.items()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, w in words.items()}
    want = components(sets, num, 100)
    got = by_id(minhash.near_duplicates(docs, num, 100), texts)
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in texts}
    kept = minhash.without_near_duplicates(docs, num=num, den=100)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(i for i in want if want[i] == i)


def test_links_past_the_first_set_of_a_bucket(spark, monkeypatch):
    """Chains of edits: with bands that any two share, all links but those to the first must come from the second comparison."""
    chance = random.Random(21)
    words = [f"w{i}" for i in range(300)]
    texts = {}
    for chain in range(6):
        text = [chance.choice(words) for _ in range(80)]
        for step in range(12):
            texts[100 * chain + step] = " ".join(text)
            for _ in range(2):
                text[chance.randrange(len(text))] = chance.choice(words)
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in texts.items() for w in [t.split()]}
    want = components(sets, 80, 100)
    assert 6 < len(set(want.values())) < len(want) - 6
    monkeypatch.setattr(minhash, "BLOCK", 5)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for rows, bands in ((1, 100), (6, 42)):
        assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, rows=rows, bands=bands).collect()} == want


def plain_line_dedup(texts, most=30):
    """id -> the lines (places among all) in a run of whole lines with `most` words that an earlier document has, by all pairs."""
    filled = {i: [(n, tuple(w)) for n, x in enumerate((t or "").split("\n")) if (w := spaced(x))] for i, t in texts.items()}
    seen, gone = set(), {}
    for i in sorted(filled):
        lines, own, runs = filled[i], set(), set()
        for s in range(len(lines)):
            n = 0
            for e in range(s, len(lines)):
                n += len(lines[e][1])
                if n >= most:
                    run = tuple(x for _, x in lines[s : e + 1])
                    runs.add(run)
                    if run in seen:
                        own |= {m for m, _ in lines[s : e + 1]}
        seen |= runs
        gone[i] = own
    return gone


def test_line_dedup(docs, texts):
    few = {i: t for i, t in texts.items() if i != 126}
    gone = plain_line_dedup(few)
    got = {r["row"]["doc_id"]: r for r in linedup.deduplicated(docs.where("doc_id <> 126 or doc_id is null")).collect() if r["row"]["doc_id"] is not None}
    assert any(gone.values())
    for i, r in got.items():
        lines = None if texts[i] is None else texts[i].split("\n")
        assert (r["n_removed"], r["n_lines"]) == (len(gone[i]), len(lines or [])), i
        assert r["text"] == (lines if lines is None else "\n".join(x for n, x in enumerate(lines) if n not in gone[i])), i
    left = linedup.without_repeated_lines(docs)
    assert left.columns == docs.columns and left.where("n_chars <> length(text) and doc_id is not null").count() == 0


def test_lines_against_every_earlier_document(spark):
    long, short, other = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 40), ("b", 5), ("c", 40)))
    rows = [(1, long), (2, f"{long}\n{short}"), (3, f"x\n{long}\n{short}\ny"), (4, f"{short}\n{other}"), (5, f"z\n{short}\n{other}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cut = lambda df: {r["o"]: r["text"] for r in linedup.deduplicated(df).collect()}
    assert cut(df) == {1: long, 2: short, 3: "x\ny", 4: f"{short}\n{other}", 5: "z"}
    assert cut(df.where("doc_id <> 1"))[3] == "x\ny"


def test_line_dedup_of_odd_lines(spark):
    """Short lines in all orders, repeated in a document and over documents."""
    chance = random.Random(11)
    pool = [" ".join(f"w{n}x{i}" for i in range(chance.randint(1, 6))) for n in range(7)]
    texts = {i: "\n".join(chance.choice([*pool, "", " "]) for _ in range(chance.randint(0, 12))) for i in range(40)}
    gone = plain_line_dedup(texts, 9)
    got = {r["o"]: r["text"] for r in linedup.deduplicated(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 9).collect()}
    assert got == {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in texts.items()}


def _shared(texts, most):
    """The last text's lines and counts, and what it shares with the texts before it."""
    number, seen = {}, {}
    every = [np.array([number.setdefault(x, 7 + len(number)) for x in t.split("\n")], np.uint64) for t in texts]
    words = [np.array([len(x.split()) for x in t.split("\n")], np.int32) for t in texts]
    for o, (lines, counts) in enumerate(zip(every[:-1], words[:-1], strict=True)):
        for at, key, span in zip(*(x.tolist() for x in linedup._runs(lines, counts, most)), strict=True):
            seen.setdefault(key, (o, at, lines[at : at + span].tobytes()))
    keys = [k for k in sorted(set(linedup._runs(every[-1], words[-1], most)[1].tolist())) if k in seen]
    o, at = (np.array([seen[k][i] for k in keys], np.int64) for i in (0, 1))
    return every[-1], words[-1], [o, o, np.array(keys, np.uint64).view(np.int64), at], [seen[k][2] for k in keys]


def test_moved_blocks_go_by_alignment_alone(monkeypatch):
    """Blocks in another order, overlapping ones and chance repeats against all runs; without patience diff nothing goes."""
    chance = random.Random(5)
    pool = [" ".join(f"w{n}x{i}" for i in range(chance.randint(1, 9))) for n in range(9)]
    cases, moved = [], 0
    for _ in range(400):
        texts = ["\n".join(chance.choice(pool) for _ in range(chance.randint(1, 14))) for _ in range(3)]
        parts = texts[0].split("\n")
        cut = chance.randint(0, len(parts))
        texts.append("\n".join([*parts[cut:], *parts[:cut], *texts[1].split("\n")[:6]]))
        lines, counts, shared, runs = _shared(texts, 9)
        if runs:
            cases.append((lines, counts, shared, runs, sorted(plain_line_dedup(dict(enumerate(texts)), 9)[3])))
    for *given, want in cases:
        assert [n for a, b in linedup.common_blocks(*given, 9) for n in range(a, b)] == want
        moved += bool(want)
    assert moved > 200
    monkeypatch.setattr(linedup, "patience", lambda a, b: [])
    assert not any(linedup.common_blocks(*given, 9) for *given, _ in cases)


def test_fingerprints(docs, texts):
    ids = sorted(texts, reverse=True)
    order = [(i, texts[i] or "") for i in ids]
    canon = lambda t: re.sub(r"[\s\x1c-\x1f\x85\xa0]+", " ", unicodedata.normalize("NFD", unicodedata.normalize("NFD", t).casefold())).strip(" ")
    plain = docs.where("source is not null")
    got = {r["o"]: r for r in fingerprint.groups(plain, fingerprint.edited(plain)).collect()}
    for n, (i, t) in enumerate(order):
        following = order[(n + 1) % len(order)]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[1][:half]
        same = [j for j, u in order if canon(u) == canon(t)]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["group_id"], r["group_size"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), min(same), len(same))
        assert r["near_next"] == float(canon(t) == canon(following[1])) and r["near_edited"] == float(canon(t) == canon(edited))
    assert fingerprint.edited(docs).count() == docs.count()


def test_fingerprints_over_many_ranges(docs, texts, monkeypatch):
    plain = docs.where("source is not null")
    want = {r["o"]: r["edited_sha256"] for r in fingerprint.edited(plain).collect()}
    for size, splits in ((2000, 1024), (3000, 8)):
        monkeypatch.setattr(fingerprint, "_RANGE_BYTES", size)
        monkeypatch.setattr(fingerprint, "_SPLITS", splits)
        assert {r["o"]: r["edited_sha256"] for r in fingerprint.edited(plain).collect()} == want


def test_hot_ids_are_cut_into_ranges(spark, monkeypatch):
    chance = random.Random(4)
    rows = [(None if i % 3 else i, "".join(chance.choice("ab c") for _ in range(40)) + str(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(tuple(r) for r in fingerprint.edited(df).collect())
    monkeypatch.setattr(fingerprint, "_RANGE_BYTES", 700)
    assert sorted(tuple(r) for r in fingerprint.edited(df).collect()) == whole
    ranged = fingerprint._ranged(fingerprint.keyed(df).select("o", "k", "text"))
    assert ranged.groupBy("range").count().agg(F.max("count")).first()[0] < 60


def test_full_case_folding(spark):
    chance = random.Random(3)
    pool = ["ß", "ẞ", "SS", "ss", "ﬁ", "FI", "Σ", "σ", "ς", "ſ", "s", "İ", "i\u0307", "ᾳ", "ΑΙ", "α\u0345\u0301", "ά\u0345", "µ", "Μ", "Ꭰ", "ꭰ", "ŉ", " ", "ǰ", "Å", "\u212b", "եւ", "և"]
    texts = ["".join(chance.choice(pool) for _ in range(chance.randint(1, 3))) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r["i"]: r["f"] for r in rows.select("i", fingerprint.fingerprint(F.col("t")).alias("f")).collect()}
    canon = lambda t: re.sub(" +", " ", unicodedata.normalize("NFD", unicodedata.normalize("NFD", t).casefold())).strip(" ")
    by, back = {}, {}
    for i, t in enumerate(texts):
        assert by.setdefault(canon(t), got[i]) == got[i] and back.setdefault(got[i], canon(t)) == canon(t), t


def test_normal_form(spark):
    chance = random.Random(3)
    pool = [chr(c) for c in (65, 0xE9, 0x301, 0x323, 0x344, 0xAC00, 0xD7A3, 0x1161, 0x212B, 0xF900, 0x2F800, 0x1D15E, 0x0F73, 0x0F72, 0x1E69, 0x20, 0xDF, 0x130, 0x903, 0x5B4)]
    texts = ["".join(chance.choice(pool) for _ in range(chance.randint(0, 12))) for _ in range(800)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    assert {r["i"]: r["x"] for r in rows.select("i", fingerprint.nfd(F.col("t")).alias("x")).collect()} == {i: unicodedata.normalize("NFD", t) for i, t in enumerate(texts)}


def test_packing_holds_every_id_once(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encode = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path, sequence=256, group_docs=40).collect()
    by, full = {}, {}
    for p in pieces:
        by.setdefault(p["doc_id"], []).append(p)
        full.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert set(by) == {None, *texts}
    for i, t in texts.items():
        if i == 5:
            continue  # it's there twice
        ids = [*encode.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for p in sorted(by[i], key=lambda p: p["start"]):
            part = b"".join(x.to_bytes(4, "little") for x in ids[at : at + p["length"]])
            assert (p["start"], p["ids_crc32"], p["doc_tokens"]) == (at, zlib.crc32(part), len(ids))
            at += p["length"]
        assert at == len(ids)
    for parts in full.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(p["length"] for p in pieces) > 0.95 * 256 * (len(full) - 8)


@pytest.mark.parametrize("text", ["don't stop", "İstanbul ΣΑΣ ﬁ", "a\u00a0b\u2003c", "<|endoftext|> x", "x²3 ½ª º µ", "e\u0301 \u0301", "漢字 and 123abc", "'S 'T we'LL", "\x00\x1f a\x85b", ""])
def test_short_way_of_encoding(text):
    import pyarrow as pa
    import public_tokenizers

    encode = packing._Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert encode.short
    ids, bounds = encode(pa.array([text, text + " end"]))
    assert ids[bounds[0] : bounds[1]].tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_url_filter(spark):
    urls = ["http://A.Example.org/es/1?x", "https://example.org/en/12", "x://org", "http://notorg/fr/", "http://b.com/fr/9", "http://b.com/de/9#x", "http://b.com", None, "nothing", "http://c.net/fr/7", "http://b.com/fr/9", ""]
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: tuple(r)[1:5] for r in urlfilter.judged(rows).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2][:3] == ("org", "", None) and got[3][2] is None and got[4][2:] == ("com/fr/", "allow") and got[5] == ("b.com", "/de/9", "com/de/", "block")
    assert got[7][:3] == got[8][:3] == ("", "", None) and got[9][2] is None and got[10] == got[4]
    assert {r["verdict"] for r in urlfilter.judged(rows.where("page_id in (3, 7, 9)")).collect()} == {"allow"}
    assert urlfilter.judged(rows.limit(0)).count() == 0


def test_sharding(docs, texts):
    got = [r for r in sharding.sharded(docs, 4000).collect()]
    sums = {}
    for r in got:
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["n_bytes"]
    assert len(got) == len(texts) + 2
    for r in got:
        assert r["shard_bytes"] == sums[r["shard"]] and len(r["shard"]) == r["depth"] and r["fits"] == (sums[r["shard"]] <= 4000)
        if r["depth"]:  # its parent bucket was too large
            assert sum(n for s, n in sums.items() if s.startswith(r["shard"][:-1])) > 4000
    assert [r["doc_id"] for r in got if not r["fits"]] == [126]
    assert {r["shard"] for r in sharding.sharded(docs, 1 << 40).collect()} == {""}


def test_shards_are_written_whole(spark, tmp_path):
    rows = [(1, "a" * 50, "x"), (1, "a" * 50, "x"), (None, "n" * 80, None), (None, None, "y"), *[(i, "b" * 30, "z") for i in range(2, 40)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    sharding.write_shards(df, 200, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in back.select(*df.columns).collect()), key=key) == sorted(rows, key=key)
    placed = sharding.sharded(df, 200)
    listed = sharding.directory(placed).orderBy("first_entry").collect()
    depth = placed.first()["global_depth"]
    assert depth == max(r["depth"] for r in listed) and sum(r["n_rows"] for r in listed) == len(rows)
    for r in listed:  # an entry's bits begin with its shard's
        assert format(r["first_entry"], f"0{depth}b")[: r["depth"]] == format(r["last_entry"], f"0{depth}b")[: r["depth"]] == r["shard"]
    assert all(x["last_entry"] < y["first_entry"] for x, y in zip(listed, listed[1:]))
    with pytest.raises(ValueError, match="shard"):
        sharding.write_shards(df.withColumnRenamed("h", "shard"), 200, str(tmp_path / "no"))


def test_language(docs, texts, spark):
    chance = random.Random(1)
    sets = {"en": ["the", "with", "house", "sing"], "fr": ["élan", "que", "maison", "eau"], "de": ["straße", "und", "haus", "über"]}
    rows = [(i, " ".join(chance.choice(sets[g]) for _ in range(chance.randint(3, 30))), g) for i in range(300) for g in [["en", "fr", "de"][i % 3]]] + [(900, None, "en"), (901, "12 !", "fr"), (902, "maison", None), (None, "the house", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df.where(~language.held_out()))
    got = {r["doc_id"]: r for r in language.predict(df, model).collect()}
    assert all(got[i]["lang_pred"] == g for i, _, g in rows[:300]) and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "fr"
    assert {r["h"] for r in df.select("doc_id", language.held_out().alias("h")).collect()} == {True, False}
    empty = language.train(df.limit(0))
    assert {r["lang_pred"] for r in language.predict(df, empty).collect()} == {"und"}
    left = language.with_known_language(docs)
    assert left.columns == docs.columns and not {120, 121, 122} & {r["doc_id"] for r in left.collect()}


def test_language_filter_against_plain_sets(spark):
    """The filter's popcounts against sets of n-grams, and its decisions against theirs."""
    chance = random.Random(7)
    letters = {"en": "abcdeéf", "fr": "abcgéh", "de": "aßbijk"}
    word = lambda g: "".join(chance.choice(letters[g]) for _ in range(chance.randint(1, 5)))
    rows = [(i, " ".join(word("de" if i % 45 == 0 and n == 3 else g) for n in range(chance.randint(4, 200))), g) for i in range(200) for g in [["en", "fr", "de"][i % 3]]]

    def grams(text):
        x = re.sub(rb"[\x00-\x60\x7b-\x7f]", b" ", f" {text} ".lower().encode() if text.isascii() else f" {text} ".translate(LOW).encode())
        return [x[i : i + 4] for i in range(len(x) - 3) if x[i + 1 : i + 3] != b"  " and x[i : i + 4].strip(b" ")]

    counts = {g: {} for g in letters}
    for _, t, g in rows:
        for x in grams(t):
            counts[g][x] = counts[g].get(x, 0) + 1
    total = {g: sum(c.values()) for g, c in counts.items()}
    top = {}
    for g, c in counts.items():
        for x, n in c.items():
            top[x] = max(top.get(x, 0), n / total[g])
    sets = {g: set(c) for g, c in counts.items()}  # all languages of an n-gram, however rare there
    at_home = {g: {x for x, n in c.items() if n / total[g] >= language.FOREIGN * top[x]} for g, c in counts.items()}
    assert any(sets[g] - at_home[g] for g in sets)
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), hashes=8)
    assert sorted(model.languages) == sorted(sets)
    held = [(i, " ".join(word(g) for _ in range(chance.randint(1, 6)))) for i in range(90) for g in [["en", "fr", "de"][i % 3]]]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(spark.createDataFrame(held, "doc_id long, text string"), model).collect()}
    for i, t in held:
        own = grams(t)
        home = {g: sum(x in at_home[g] for x in own) for g in model.languages}
        hits = {g: sum(x in sets[g] for x in own) + home[g] for g in model.languages}
        name, score = got[i]
        assert hits[name] == max(hits.values()) and abs(score - home[name] / max(len(own), 1)) < 0.01, t
    coded = np.frombuffer(b"".join(x for g in letters for x in sorted(sets[g])), "<u4")
    owner = np.repeat(np.arange(3), [len(sets[g]) for g in letters])
    total, contained, _ = model.popcounts(coded, owner, 3)
    assert all(contained[n, model.languages.index(g)] > total[n] - 0.5 for n, g in enumerate(letters))  # the filter holds them all


def test_contamination(docs, texts, spark):
    items = [("7", texts[7]), ("short", "one two"), ("p", texts[115].split("\n")[1]), ("none", "!!"), ("null", None), (None, " ".join(alnum(texts[9])[:13]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    windows = {}
    for name, t in items:
        w = alnum(t)
        n = min(13, len(w))
        for s in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[s : s + n]), set()).add(name)
    want = {}
    for i, t in texts.items():
        w, hit, names = alnum(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    names |= windows[tuple(w[s : s + n])]
        want[i] = (len(w), len(hit), sorted(x for x in names if x), bool(hit) and 20 * len(hit) >= len(w))
    found = lambda df: {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in df.collect() if r["doc_id"] is not None}
    assert found(decontaminate.contamination(docs, bench)) == want
    left = decontaminate.without_contamination(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect() if r["doc_id"] is not None} == {i for i in want if not want[i][3]}


def test_repeated_rows_stay_over_blocks_of_any_size(spark):
    text = "one two three four five six"
    rows = [(1, text), (1, text), (None, text), (None, text), (2, "other"), (3, "one two"), (4, "six one two three")]
    items = spark.createDataFrame([("i", text), ("j", "one two three"), ("k", "six")], "item_id string, text string")
    found = []
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        found.append(sorted((r["o"], r["k"], str(r["ranges"]), r["items"]) for r in decontaminate.search(decontaminate.build_index(docs), decontaminate.phrases(items, width=3)).collect()))
    assert len(found[0]) == len(rows) and found[0] == found[1]
    assert [r[3] for r in found[0]].count(["i", "j", "k"]) == 5


def test_a_text_longer_than_a_chunk(spark):
    long = "filler words here " * 150_000
    docs = spark.createDataFrame([(1, long + "alpha beta gamma delta " + long), (2, "alpha beta gamma delta")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "alpha beta gamma delta"), ("absent", "alpha nowhere")], "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"]), [tuple(x) for x in r["ranges"]]) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: (900_004, 4, ["i"], [(450_000, 450_004)]), 2: (4, 4, ["i"], [(0, 4)])}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x red a blue b y"), (2, "red blue"), (3, "blue a b c red"), (4, "red"), (5, "blue q red")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "red blue")], "item_id string, text string")
    near = decontaminate.contamination(docs, items, slop=1)
    assert {r["doc_id"] for r in near.where("size(items) > 0").collect()} == {1, 2, 5}


def test_proximity_against_every_window(spark):
    chance = random.Random(9)
    rows = [(i, " ".join(chance.choice("abcdefgh") for _ in range(chance.randint(0, 25)))) for i in range(60)]
    items = [("1", "a b c"), ("2", "d d"), ("3", "h"), ("4", "a c e g")]
    for slop in (1, 3):
        got = {r["doc_id"]: (r["n_hit"], list(r["items"])) for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), slop=slop).collect()}
        for i, t in rows:
            w, hit, names = t.split(), set(), set()
            for name, x in items:
                terms, reach = set(x.split()), len(x.split()) + slop
                for s in range(len(w)):
                    if terms <= set(w[s : s + reach]):
                        hit |= set(range(s, min(s + reach, len(w))))
                        names.add(name)
            assert got[i] == (len(hit), sorted(names)), t


def test_licenses(docs, texts, spark):
    said = ["Licensed under the Apache License, Version 2.0.", "under the MIT License and cc-by CC BY-NC 4.0", "GNU General Public License v3 or GPL", None, "", "mit  license mit\tlicense", "SPDX-License-Identifier: BSD-3-Clause", "summit licenses"]
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license.digest(license.scan(df)).collect()}
    assert got[0]["labels"] == "apache,apache-2.0" and got[0]["first_word"] == 3 and got[0]["score"] == 1.0
    assert got[1]["base_labels"] == "cc-by,mit" and "cc-by-nc-4.0" in got[1]["labels"] and got[1]["n_base"] == 3
    assert got[2]["labels"] == "gpl,gpl-3.0" and got[5]["n_base"] == 2 and got[6]["labels"] == "bsd-3-clause"
    assert got[3]["n_words"] == 0 and got[4]["first_word"] is None and got[7]["labels"] == ""
    assert len(license_rules.rules()) > 200 and license.scan(docs).count() == docs.count()
    many = license.digest(license.scan(spark.createDataFrame([(1, "mit license " * 3000)], "doc_id long, text string"))).first()
    assert many["n_base"] == 3000 and many["last_word"] == 5998


def test_license_suppression(spark):
    rules = [{"number": i, "base": False, "label": n, "priority": p, "keyword": k, "expression": x} for i, (n, p, k, x) in enumerate([("long", 2, "a", "a b c"), ("low", 1, "b", "b c"), ("high", 3, "b", "b"), ("over", 1, "c", "c d"), ("same", 2, "a", "a b c")])]
    df = spark.createDataFrame([(1, "A b C d")], "doc_id long, text string")
    assert [x["label"] for x in license.scan(df, rules).first()["kept"]] == ["long", "high", "over"]


def test_licenses_against_every_rule_on_every_text(docs, texts, spark):
    """Each rule by Python's own expressions, and containment by all pairs of detections."""
    rules = license_rules.rules()
    said = dict(texts)
    chance = random.Random(2)
    parts = ["apache license version 2 0", "licensed under the apache license version 2 0 the license", "mit license", "gnu general public license version 3", "GPL v2 or later", "cc by sa 4.0", "CC-BY", "spdx license identifier mit", "the", "Public Domain", "bsd 3 clause license", "under", "2", "gnu lesser general public license"]
    for i in range(200, 300):
        said[i] = " ".join(chance.choice(parts) for _ in range(chance.randint(1, 12) if i < 299 else 600))
    df = spark.createDataFrame(list(said.items()), "doc_id long, text string")
    for r in license.digest(license.scan(df)).collect():
        words = alnum(said[r["doc_id"]])
        text = f" {' '.join(words)} " if words else " "
        found = []
        for x in rules:
            for m in re.finditer(f"(?<= )(?:{x['expression']})(?= )", text):
                s = text[: m.start()].count(" ") - 1
                found.append((s, s + m.group().count(" ") + 1, x))
        inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1] and b[2]["priority"] >= a[2]["priority"] and (b[1] - b[0], b[2]["priority"], -b[2]["number"]) > (a[1] - a[0], a[2]["priority"], -a[2]["number"])
        kept = [a for a in found if not any(inside(a, b) for b in found)]
        base = [a for a in found if a[2]["base"]]
        starts = [a[0] for a in base]
        labels = lambda rows: ",".join(sorted({a[2]["label"] for a in rows}))
        want = (len(words), len(base), min(starts, default=None), max(starts, default=None), labels(base), labels(base + kept), max((license.CONFIDENCE[a[2]["priority"]] for a in kept), default=0.0))
        assert tuple(r)[1:] == want, said[r["doc_id"]]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def test_each_title_alone_gives_a_name(spark):
    titles = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Señor Señora".split()
    texts = [f"{t}{dot} Meier" for t in titles for dot in ("", ".")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in df.select("doc_id", pii._spans(F.col("text"), pii.ADDED["name"], pii._GATES["name"]).alias("s")).where("size(s) = 1").collect()}
    assert got == set(range(len(texts)))


def test_personal_data(docs, spark):
    chance = random.Random(8)
    pool = ["a.b@c.de", "x@y", "@", "_d@e.f-g.h", "1.2.3.4", "1.2.3.4.5.6", "256.1.1.1", "0001.2.3.004", "4111 1111-1111 1111", "4111111111111112", "+1 (212) 555-0100", "+12", "+49 30 123456789", "é", "漢", " ", "\n", ".", "-", "7", "token = \"abcDEF1234567890\""]
    said = ["".join(chance.choice(pool) for _ in range(chance.randint(0, 9))) for _ in range(500)] + [None, "", "7" * 3000, "a" * 5000 + "@" + "b." * 3000 + "c", "".join(chance.choice(pool) for _ in range(5000))]
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    for r in pii.digest(pii.found(df)).collect():
        t = said[r["doc_id"]] or ""
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, t) if valid(k, m.group())]
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), t
        assert set(spans) <= set(r["spans"].split(","))or not spans
        assert r["n_card"] == sum(s.startswith("card:") for s in spans)
    assert pii.found(docs).count() == docs.count() and pii.found(docs.limit(0)).count() == 0


def test_added_spans(spark):
    df = spark.createDataFrame([(i, f'please write to a{i}@b.org or token = "f3ef4d6b2755a36d{i}" now') for i in range(40)], "doc_id long, text string")
    assert all("secret:" in r["spans"] and r["n_email"] == 1 for r in pii.digest(pii.found(df)).collect())


def test_added_kinds_are_found_and_apart(spark):
    """Planted data of each added kind among plain texts and numbers that aren't personal."""
    chance = random.Random(6)
    word = lambda: "".join(chance.choice("abcdefghij") for _ in range(chance.randint(3, 8)))
    number = lambda n: "".join(chance.choice("23456789") for _ in range(n))
    plant = {
        "ssn": lambda: ("social security ", f"{number(3)}-{number(2)}-{number(4)}"), "tel": lambda: ("call my phone ", f"({number(3)}) {number(3)}-{number(4)}"), "iban": lambda: ("pay to bank account ", f"DE{number(2)} {number(4)} {number(4)} {number(4)} {number(4)} {number(2)}"),
        "name": lambda: ("signed by ", chance.choice(["Dr. Anna Weber", "Mr John Smith", "Frau Meier"])), "secret": lambda: ("token = ", "gh" + "p_" + "".join(chance.choice("abcdef0123456789") for _ in range(24))),
    }
    rows, want = [], {}
    for i in range(400):
        kind = [*plant, None, None, None][i % 8]
        before = " ".join(word() for _ in range(6)) + " "
        cue, said = plant[kind]() if kind else (chance.choice(["order ", "version ", "page "]), f"{number(3)}.{number(3)}.{number(4)}")
        rows.append((i, f"{before}{cue}{said} {word()}"))
        if kind:
            want[i] = f"{kind}:{len(before) + len(cue)}:{len(before) + len(cue) + len(said)}"
    got = {r["doc_id"]: [s for s in r["spans"].split(",") if s] for r in pii.digest(pii.found(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for kind in plant:
        mine = [i for i, s in want.items() if s.startswith(kind)]
        assert sum(want[i] in got[i] for i in mine) >= 0.9 * len(mine), kind
    assert sum(bool(got[i]) for i in got if i not in want) <= 0.1 * (len(rows) - len(want))
    for spans in got.values():
        ends = sorted((int(s.split(":")[1]), int(s.split(":")[2])) for s in spans)
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_overlapping_added_spans_leave_one(spark):
    df = spark.createDataFrame([(i, f"token = 212-555-{1000 + i}abcdef call 212-555-{2000 + i}") for i in range(60)], "doc_id long, text string")
    for r in pii.digest(pii.found(df)).collect():
        ends = sorted((int(s.split(":")[1]), int(s.split(":")[2])) for s in r["spans"].split(",") if s)
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_bitmap_loses_no_key(spark):
    keys = spark.range(500).select(F.xxhash64("id").alias("k"))
    all_ = spark.range(5000).select(F.xxhash64("id").alias("k"))
    some = all_.where(among(keys, 12))
    assert keys.join(some, "k", "left_anti").count() == 0 and some.count() < 1500


@pytest.mark.parametrize("run", [
    lambda d: minhash.near_duplicates(d), lambda d: linedup.deduplicated(d), lambda d: fingerprint.edited(d), lambda d: sharding.sharded(d, 10), lambda d: license.scan(d), lambda d: decontaminate.contamination(d, d.select(F.col("doc_id").alias("item_id"), "text")),
])
def test_no_documents(docs, run):
    assert run(docs.limit(0)).count() == 0


def test_folds_in_parts_give_an_item_for_each_entry(spark):
    for n in (0, 1, 127, 128, 129, 300, 20000):
        rows = spark.range(1).select(F.sequence(F.lit(1), F.lit(n)).alias("a") if n else F.expr("cast(array() as array<int>)").alias("a"))
        got = rows.select(collected(F.col("a"), F.lit(0), "int", lambda at, x: at, lambda at, x: at + x)).first()[0]
        assert got == [i * (i + 1) // 2 for i in range(n)]


def test_spans_that_meet_another(spark):
    chance = random.Random(12)
    rows = []
    for i in range(200):
        cuts = sorted(chance.sample(range(60), 2 * chance.randint(0, 8)))
        s = chance.randint(0, 58)
        rows.append((i, list(zip(cuts[::2], cuts[1::2])), (s, chance.randint(s + 1, 60))))
    df = spark.createDataFrame(rows, "i long, spans array<struct<s:int,e:int>>, x struct<s:int,e:int>")
    for i, spans, x, got in df.select("i", "spans", "x", meeting(F.col("spans"), F.col("x"))).collect():
        assert got == [y for y in spans if y["s"] < x["e"] and x["s"] < y["e"]], (spans, x)
