"""The other operators against plain versions, round trips and held-out labels."""

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mapweave.llm import licences, mixing, packing, pii, quality, simhash, warc

from .helpers import WORD, noise, rng


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, score string, spans int")


def marked(r, n):
    """Texts and marks: prose of mixed lengths, and junk of three sorts."""
    rows = []
    for i in range(n):
        text = noise(r, r.randrange(5, 120), 3000)
        bad = r.random() < 0.25
        if bad:
            words = text.split()
            text = r.choice(("*** ".join(words), " ".join(words).upper() + " !!! " * 20, " ".join(w for w in words for _ in range(5))))
        rows.append((i, text, int(not bad)))
    return rows


def test_quality_on_held_out_rows(spark):
    rows = marked(rng(4), 1500)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 2], "doc_id long, quality int")
    found = quality.score(documents(spark, [(i, t) for i, t, _ in rows]), labels).collect()
    truth = {i: q for i, _, q in rows}
    held = [x for x in found if x.held_out]
    assert len(found) == 1500 and {x.doc_id for x in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([x.predicted == truth[x.doc_id] for x in held]) > 0.9
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in found)


def test_quality_odd_rows(spark):
    rows = [(1, ""), (2, None), (None, "a b c"), (3, "\n\n \t"), (3, "é" * 50_000), (4, "word " * 30_000)]
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(documents(spark, rows), none).count() == 6
    some = spark.createDataFrame([(1, 1), (1, 0), (4, 1), (None, 1)], "doc_id long, quality int")
    assert quality.score(documents(spark, rows), some).count() == 6
    assert quality.score(documents(spark, []), some).count() == 0


def test_mixing_meets_targets(spark):
    r = rng(2)
    rows = [(i, noise(r, 40, 500) + (" rude awful" if i % 4 == 0 else "")) for i in range(600)] + [(1000, None), (1001, "")]
    labels = spark.createDataFrame([(i, "toxic" if i % 4 == 0 else "clean") for i in range(0, 600, 2)], "doc_id long, domain string")
    weights = {"clean": 0.9, "toxic": 0.1}
    found = mixing.mix(documents(spark, rows), labels, weights, keep=("score",)).collect()
    total = sum(x.tokens for x in found)
    assert len(found) == 602
    for d, w in weights.items():
        assert sum(x.rate * x.tokens * x[f"share_{d}"] for x in found) == pytest.approx(w * total, rel=0.02)
    assert all(x.rate >= 0 and x.share_clean + x.share_toxic == pytest.approx(1) for x in found)
    wrong = sum((x.share_toxic > 0.5) != (x.doc_id % 4 == 0) for x in found if x.doc_id < 600)
    assert wrong < 12
    kept = mixing.sampled(documents(spark, rows), labels, {"clean": 0.98, "toxic": 0.02}, "clean", ["doc_id", "text"]).collect()
    assert len({x.doc_id for x in kept if x.doc_id < 600 and x.doc_id % 4}) > 440
    assert sum(x.doc_id % 4 == 0 for x in kept if x.doc_id < 600) < 40


def test_mixing_of_targets_out_of_reach(spark):
    """Every document is half of either domain, so that totals stay equal: the closest rates are found, and a bound on steps is an error."""
    shares = spark.createDataFrame([(10, [0.5, 0.5]), (20, [0.5, 0.5])], "tokens long, shares array<double>")
    assert [round(x.rate, 6) for x in mixing.fit_rates(shares, [20.0, 10.0]).collect()] == [1.0, 1.0]
    far = spark.createDataFrame([(1000, [0.9, 0.1]), (1000, [0.1, 0.9])], "tokens long, shares array<double>")
    with pytest.raises(RuntimeError):
        mixing.fit_rates(far, [1500.0, 500.0], max_steps=1)


@pytest.mark.parametrize("replayed", [2, 24])
def test_mixing_rates_by_hand(spark, monkeypatch, replayed):
    """Close domains take many steps; the totals come out as the targets say, and rates aren't negative."""
    monkeypatch.setattr(mixing, "REPLAYED", replayed)
    r = np.random.default_rng(6)
    p = r.dirichlet([4, 4, 4], 300)
    tokens = r.integers(1, 500, 300)
    total = tokens @ p
    targets = [float(total.sum() * w) for w in (0.5, 0.3, 0.2)]
    rows = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p, strict=True)], "tokens long, shares array<double>")
    found = mixing.fit_rates(rows, targets).collect()
    rates, shares = np.array([x.rate for x in found]), np.array([x.shares for x in found])
    assert (rates >= 0).all()
    assert np.abs((rates * [x.tokens for x in found]) @ shares - targets).max() <= 5e-4 * sum(targets)


def test_mixing_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, domain string")
    found = mixing.mix(documents(spark, [(1, "a b"), (None, None)]), none, {"x": 1.0, "y": 1.0}).collect()
    assert [round(x.share_x, 6) for x in found] == [0.5, 0.5]
    assert mixing.mix(documents(spark, []), none, {"x": 1.0, "y": 1.0}).count() == 0


def test_licences_equal_brute_force(spark):
    mit = licences.TEMPLATES["MIT"][3]
    rows = [(1, None), (2, ""), (3, "Intro.\nReleased under the MIT License!\nMore text follows here."), (4, mit), (5, f"Title\n\n{mit}\n\nend of it"), (6, "licensed under cc by-nc 4.0"), (7, "Licensed under the moon"), (8, noise(rng(0), 3000))]
    found = {x.doc_id: (x.licence, x.n_units) for x in licences.scan(documents(spark, rows)).collect()}

    def force(text):
        best, n = None, 0
        for unit in licences.units(licences.normalise(text or "")):
            own, hits = licences.bigrams(unit), []
            for name, forms in licences.TEMPLATES.items():
                for form in forms:
                    other = licences.bigrams(licences.normalise(form).split())
                    dice = 2 * len(own & other) / (len(own) + len(other)) if own or other else 0
                    if dice >= 0.8:
                        hits.append((-dice, name))
            n += bool(hits)
            best = min([*hits, *([best] if best else [])], default=None)
        return (best and best[1], n)

    assert found == {i: force(t) for i, t in rows}
    assert found[3] == ("MIT", 1) and found[6][0] == "CC-BY-NC-4.0" and found[7][0] is None
    assert licences.scan(documents(spark, [])).count() == 0


def test_licences_across_paragraphs_and_within_prose(spark):
    around = noise(rng(1), 400)
    mit = licences.TEMPLATES["MIT"][3]
    for start in ("The above copyright", "THE SOFTWARE IS PROVIDED"):
        mit = mit.replace(start, f"\n\n{start}")
    gpl = licences.TEMPLATES["GPL-3.0"][2].replace("any later version. ", "any later version.\n\n")
    inline = f"{around} released under the MIT License {around}"
    two = f"{around} licensed under CC BY 4.0 {around} licensed under the BSD 2-Clause License {around}"
    older = f"{around} licensed under the Apache License, Version 1.1 {around}"
    rows = [(1, f"{around}\n\nMIT License\n\nCopyright (c) 2020 A B\n\n{mit}\n\n{around}"), (2, f"{around}\n\n{gpl}\n\n{around}"), (3, inline), (4, two), (5, older), (6, f"{around} {mit} {around}")]
    assert "\n\n" in gpl and mit.count("\n\n") == 2
    found = {x.doc_id: (x.licence, x.n_units, x.licences) for x in licences.scan(documents(spark, rows)).collect()}
    assert found[1] == found[3] == found[6] == ("MIT", 1, "MIT")
    assert found[2] == ("GPL-3.0", 1, "GPL-3.0")
    assert found[4] == ("BSD", 2, "BSD,CC-BY-4.0") and found[5] == (None, 0, "")


def licence_by_force(text, templates, least=0.8):
    """The largest Dice coefficient of any run of words with any of the longer templates, and the first name that reaches it."""
    words = re.findall("[a-z0-9]+", text.lower())
    best = (0.0, "")
    for name, forms in templates.items():
        for form in forms:
            own = re.findall("[a-z0-9]+", form.lower())
            other = set(zip(own, own[1:], strict=False))
            for a in range(len(words)):
                seen, both = set(), 0
                for x in range(a, len(words) - 1):
                    pair = (words[x], words[x + 1])
                    if pair not in seen:
                        seen.add(pair)
                        both += pair in other
                    dice = 2 * both / (len(seen) + len(other))
                    if dice > best[0] + 1e-12 or dice > best[0] - 1e-12 and name < best[1]:
                        best = (max(dice, best[0]), name)
    return (best[1], best[0]) if best[0] >= least else (None, None)


def test_licences_by_force(spark):
    r = rng(17)
    templates = {name: tuple(f for f in forms if len(f.split()) > licences.SHORT) for name, forms in licences.TEMPLATES.items()}
    templates = {name: forms for name, forms in templates.items() if forms}
    rows = []
    for name, forms in sorted(templates.items()):
        words = forms[-1].split()
        for edits in (0, len(words) // 12, len(words) // 5):
            own = list(words)
            for _ in range(edits):
                own[r.randrange(len(own))] = f"x{r.randrange(99)}"
            cut = r.randrange(1, len(own) - 1)
            rows.append((len(rows), f"{noise(r, 30)} {' '.join(own[:cut])}\n\n{' '.join(own[cut:])} {noise(r, 30)}"))
    found = {x.doc_id: (x.licence, x.dice) for x in licences.scan(documents(spark, rows), templates=templates).collect()}
    for i, text in rows:
        name, dice = licence_by_force(text, templates)
        assert found[i][0] == name, (i, found[i], name, dice)
        assert found[i][1] == (None if dice is None else pytest.approx(dice))


def test_simhash(spark):
    r = rng(8)
    texts = [noise(r, r.randrange(3, 60), 300) for _ in range(300)] + ["", None, "a", "é ü ö ä ß x", "same text of six words here"] * 2 + ["w " * 70_000]
    rows = [(i * 3 - 200, t) for i, t in enumerate(texts)]
    found = {x.doc_id: x for x in simhash.digest(documents(spark, rows), every=5).collect()}
    order = sorted(rows, reverse=True)
    prints = {i: int(found[i].fingerprint, 16) for i, _ in rows}
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)]
        half = len(text) // 2
        edited = text[: len(text) - half] + (after[1] or "")[:half]
        assert found[i].n_chars == len(text)
        assert found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert found[i].near_next == 1 - (prints[i] ^ prints[after[0]]).bit_count() / 64
        if i % 5 == 0:
            assert found[i].n_within == sum((prints[i] ^ p).bit_count() <= 3 for p in prints.values()) - 1
    assert len({x.fingerprint for x in found.values() if not dict(rows)[x.doc_id]}) == 1


def test_simhash_neighbours_of_far_ids(spark, monkeypatch):
    """A few ids far from all others don't gather the texts in one range."""
    monkeypatch.setattr(simhash, "RANGE_ROWS", 4)
    monkeypatch.setattr(simhash, "HEAVY", 2)
    ids = [*range(0, 600, 3), 10**15, -(10**15), 2**62, None]
    rows = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    cuts = simhash._cuts(rows)
    assert len(cuts) >= 3
    sizes = simhash._ranged(rows, cuts).groupBy("range").count().agg(F.max("count")).first()[0]
    assert sizes <= 8
    order = sorted((i for i in ids if i is not None), reverse=True) + [None]
    found = {r.doc_id: r.next_text for r in simhash._with_next(rows, "text").collect()}
    assert found == {i: f"text {order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


def simhash_by_hand(text):
    """Words and shingles hashed by the xxhash library, each hash seeded by the one before it; then a majority on every bit."""
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text.lower())]
    own = [words[i : i + 5] for i in range(len(words) - 4)] if len(words) >= 5 else [words] if words else []
    hashes = []
    for shingle in own:
        h = 42
        for w in shingle:
            h = xxhash.xxh64_intdigest(w.to_bytes(8, "little"), h)
        hashes.append(h)
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_by_hand(spark):
    r = rng(31)
    texts = ["One two three four five six seven", "a a a a a a a b", "just three words", "", "é ü\tß x\ny z", *(noise(r, r.randrange(80), 40) for _ in range(40))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", simhash.fingerprint(F.col("t")).alias("f")).collect()
    assert [r.f % (1 << 64) for r in rows] == [simhash_by_hand(r.t) for r in rows]


def test_simhash_votes(spark):
    """The packed counters agree with counting bit by bit."""
    terms = [(x * 0x9E3779B97F4A7C15 + 12345) % (1 << 64) for x in range(1, 40_001)]
    signed = [t - (1 << 64) if t >> 63 else t for t in terms]
    for n in (0, 1, 500, 40_000):
        df = spark.createDataFrame([(signed[:n],)], "t array<long>")
        assert df.select(simhash._votes(F.col("t")).alias("v")).first().v == [sum(t >> b & 1 for t in terms[:n]) for b in range(64)]


def test_simhash_odd_rows(spark):
    rows = [(None, "a b"), (None, None), (1, "x y z"), (1, "x y z"), (1, "q")]
    assert simhash.digest(documents(spark, rows)).count() == 5
    assert simhash.digest(documents(spark, [])).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()]
    return 12 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


VALID = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": luhn, "phone": lambda m: 9 <= sum(c.isdigit() for c in m) <= 15}


def base_spans(text):
    found = [(m.start(), k, m.end(), name) for k, (name, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if VALID[name](m.group())]
    return ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(found))


def test_pii_base_spans(spark):
    r = rng(6)
    alphabet = "0123456789 .-+()@aZé_%"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(120))) for _ in range(400)]
    texts += [None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "0001.2.3.004", "+1 (743) 555-3824", "ü" * 9 + "me@x-y.org", "7" * 30_000, "1." * 5000]
    rows = list(enumerate(texts))
    found = {x.doc_id: x for x in pii.digest(documents(spark, rows)).collect()}
    for i, t in rows:
        assert found[i].base_sha256 == hashlib.sha256(base_spans(t or "").encode()).hexdigest(), t
    assert pii.digest(documents(spark, [])).count() == 0


def test_pii_added_spans_and_redaction(spark):
    text = "pay DE89 3704 0044 0532 0130 00 not DE88 3704 0044 0532 0130 00; ssn 123-45-6789, part 123-45-6789 é"
    rows = documents(spark, [(1, text), (2, "mail a@b.org, card 4111 1111 1111 1111"), (3, None), (4, "clean")])
    spans = {x.doc_id: x.spans for x in pii.digest(rows).collect()}
    assert [s.split(":")[0] for s in spans[1].split(",")][:2] == ["iban", "ssn"]
    masked = {x.doc_id: x.text for x in pii.redact(rows).collect()}
    assert masked[2] == "mail <EMAIL>, card <CARD>" and masked[3] is None and masked[4] == "clean"
    assert masked[1].startswith("pay <IBAN> not DE88")


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://x/{i}", h) for i, h in enumerate(["<a>", "<b>", "<a>", "", None, "ü" * 200_000, "<a>", "\r\n\r\n WARC/1.1"])]
    rows += [(None, "u\r\nv", "<a>"), (6, "again", "<a>")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    found = sorted(map(tuple, warc.round_trip(pages).collect()), key=str)
    expected = []
    for page, _, html in rows:
        data = (html or "").encode()
        last = max(p for p, _, h in rows if p is not None and (h or "") == (html or ""))
        refers = last if page is not None and page < last else None
        expected.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers))
    assert found == sorted(expected, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0
    kept = warc.read_records(warc.archive(pages, least_bytes=10**9)).collect()
    assert sorted(x.html for x in kept) == sorted(h or "" for _, _, h in rows)


def test_files_of_one_name_stay_apart(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<a>"), (2, "v", "<b>")], "page_id long, url string, html string")
    written = [warc.write_monolithic(warc.with_revisits(pages.filter(f"page_id = {i}")).coalesce(1), str(tmp_path / f"in{i}")).collect() for i in (1, 2)]
    files = [r.file for rows in written for r in rows if r.records]
    assert len(files) == 2 and len({f.rpartition("/")[2] for f in files}) == 1
    index = warc.normalise(spark.createDataFrame([(f,) for f in files], "file string"), str(tmp_path / "out"))
    assert sorted(x.html for x in warc.read_records(index).collect()) == ["<a>", "<b>"]


def test_rows_without_ids_have_their_spans(spark):
    rows = [(None, "mail a@b.org"), (None, "mail a@b.org"), (1, "mail a@b.org"), (1, None)]
    assert sorted((str(x.doc_id), x.n_email, x.spans) for x in pii.digest(documents(spark, rows)).collect()) == [("1", 0, ""), ("1", 1, "email:5:12"), ("None", 1, "email:5:12"), ("None", 1, "email:5:12")]


def test_licences_of_odd_rows(spark):
    rows = [(None, "Released under the MIT License."), (1, "Released under the MIT License."), (1, "Released under the MIT License."), (2, None)]
    found = sorted((str(x.doc_id), x.licence) for x in licences.scan(documents(spark, rows)).collect() if x.licence)
    assert found == [("1", "MIT"), ("1", "MIT"), ("None", "MIT")]


def test_mixing_of_repeated_ids(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "rude words here"), (None, "x y")]
    labels = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, domain string")
    found = mixing.mix(documents(spark, rows), labels, {"x": 0.5, "y": 0.5}).collect()
    assert sorted(str(x.doc_id) for x in found) == ["1", "1", "2", "None"] and all(x.rate >= 0 for x in found)
    kept = mixing.sampled(documents(spark, rows), labels, {"x": 0.5, "y": 0.5}, None, ["doc_id", "text"]).collect()
    assert sum(x.doc_id is None for x in kept) == 1


def test_inflating_many_members():
    import gzip
    import io

    data = gzip.compress(b"abc" * 1000) + gzip.compress(b"def")
    assert b"".join(warc.inflated(io.BytesIO(data))) == b"abc" * 1000 + b"def"


def test_packing(spark):
    r = rng(9)
    odd = ["", None, "a  b\n\nc ", "x" * 9000, "漢字 かな x", "<|endoftext|> y", "tab\there  ", "it's we'll 12 345"]
    rows = list(enumerate([noise(r, r.randrange(400), 10**5) for _ in range(80)] + odd + ["twice"] * 3))
    rows += [(5, "same id"), (5, "same id"), (None, "no id")]
    files = packing.byte_level(public_tokenizers)
    found = packing.best_fit(documents(spark, rows), **files, capacity=512, shard_pieces=64).collect()
    plain = Tokenizer.from_file(files["tokenizer"])
    expected = []
    for i, t in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 512 or 512
        cuts = [(0, min(first, len(ids)))] + [(a, 512) for a in range(first, len(ids), 512)]
        expected += [(i, k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(cuts)]
    assert sorted((tuple(x[:5]) for x in found), key=str) == sorted(expected, key=str)
    places = {}
    for x in found:
        places.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for p in places.values():
        p.sort()
        assert [a for a, _ in p] == list(np.cumsum([0] + [n for _, n in p])[:-1]) and sum(n for _, n in p) <= 512
    assert packing.best_fit(documents(spark, []), **files).count() == 0


def least_bins(lengths, capacity):
    """The lower bound of Martello and Toth: large pieces take bins of their own, the others fill what those leave."""
    best = 0
    for k in range(capacity // 2 + 1):
        alone = lengths[lengths > capacity - k]
        large = lengths[(lengths > capacity // 2) & (lengths <= capacity - k)]
        small = lengths[(lengths >= k) & (lengths <= capacity // 2)]
        over = small.sum() - (len(large) * capacity - large.sum())
        best = max(best, len(alone) + len(large) + max(0, -(-over // capacity)))
    return best


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_keeps_every_capacity(rule):
    r = rng(3)
    lengths = np.array([r.randrange(1, 100) for _ in range(300)])
    bins, _ = packing.pack(lengths, np.array([100, 3, 6000.0]), np.array([1, 0.05, 0.05]), rule)
    for b in set(bins):
        own = lengths[bins == b]
        assert len(own) == 1 or own.sum() <= 100 and len(own) <= 3 and (own**2).sum() <= 6000
    free, _ = packing.pack(lengths, np.array([100, 100, 10000.0]), np.array([1, 0.05, 0.05]), rule)
    assert least_bins(lengths, 100) <= len(set(free)) <= least_bins(lengths, 100) + 2
