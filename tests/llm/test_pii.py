"""Personal data: base spans against plain patterns, disguised forms with known answers, odd rows."""

import hashlib
import random
import re

from loomspan.llm import pii

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(digits) <= 19 and plain_luhn(digits), 10 <= len(digits) <= 15)[k]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_against_patterns(sf):
    random.seed(1)
    for _ in range(20_000):
        text = "".join(random.choice("ab.@-+ 0123456789%() .@1é") for _ in range(random.randint(0, 40)))
        assert pii.base_spans(text) == brute(text)
    for _ in range(3_000):
        text = "".join(random.choice("4111 1-") for _ in range(random.randint(14, 30)))
        assert pii.base_spans(text) == brute(text)


def added(text):
    base, more = pii.scan(text)
    assert base == brute(text)
    return [(pii.KINDS[k], text[s:e]) for s, k, e in more]


def test_disguised_forms():
    cases = {
        "write to john dot doe at example dot com now": ("email", "john dot doe at example dot com"),
        "mail john [at] mail.example [dot] com!": ("email", "john [at] mail.example [dot] com"),
        "mail jоhn@exаmple.com": ("email", "jоhn@exаmple.com"),
        "john@ex​ample.com": ("email", "john@ex​ample.com"),
        "ask bob at gmail.com please": ("email", "bob at gmail.com"),
        "call plus one five five five one two three four five six seven ok": ("phone", "plus one five five five one two three four five six seven"),
        "call ＋１ (980) 555-6268": ("phone", "＋１ (980) 555-6268"),
        "card four one one one 1111 1111 one one one one": ("card", "four one one one 1111 1111 one one one one"),
        "４１１１ １１１１ １１１１ １１１１": ("card", "４１１１ １１１１ １１１１ １１１１"),
        "ip 10 dot 0 dot 0 dot 1 end": ("ip", "10 dot 0 dot 0 dot 1"),
        "host 192[.]168[.]1[.]10": ("ip", "192[.]168[.]1[.]10"),
    }
    for text, want in cases.items():
        assert added(text) == [want], text
        assert want[1] not in pii.redacted(text)
    for text in ("we met at noon. dot the i", "she was at home.then left", "a @ b . c", "one two", "plain words", "[at] the dot (dot) x"):
        assert added(text) == [], text
    assert added("a@b.com and bob at gmail.com") == [("email", "bob at gmail.com")]


def test_dashes_plus_and_endings():
    cases = {
        "call plus four nine dash three zero dash one two three dash four five six ok": ("phone", "plus four nine dash three zero dash one two three dash four five six"),
        "plus 49 30 1234567": ("phone", "plus 49 30 1234567"),
        "(plus 49 301234567)": ("phone", "plus 49 301234567"),
        "mail anna at uni.it now": ("email", "anna at uni.it"),
        "jan at firma.nl": ("email", "jan at firma.nl"),
        "urs at werk.ch": ("email", "urs at werk.ch"),
        "ana at casa.co": ("email", "ana at casa.co"),
        "j.doe at site.museum": ("email", "j.doe at site.museum"),
    }
    for text, want in cases.items():
        assert added(text) == [want], text
    for text in ("we look at home.it was late", "two plus one is three", "they met at noon.then", "bob at home.so what"):
        assert added(text) == [], text


def test_shortcut_agrees_with_the_transducers(monkeypatch):
    random.seed(4)
    parts = ["plus", "four", "Nine", "sieben", "zéro", "dash", "dot", "punkt", "49", "030", "1234567", "at", "bob", "mail", "x.org", "uni.it", "@", "[at]", "(dot)", "(", "!", "_", "ſix", "·"]
    texts = ["".join(random.choice(parts) + random.choice((" ", " ", " ", "-", ", ", ".", "")) for _ in range(random.randint(3, 16))) for _ in range(20_000)]
    texts += ["plus " + "".join(random.choice(("one", "two", "3", "nine")) + random.choice((" ", " dash ", "-")) for _ in range(12)) for _ in range(2_000)]
    quick = [pii.scan(t) for t in texts]
    monkeypatch.setattr(pii, "maybe_disguised", lambda text: True)
    assert quick == [pii.scan(t) for t in texts]
    assert sum(len(more) > 0 for _, more in quick) > 1000


def test_odd_rows(spark):
    texts = [None, "", "me@x.org", "me@x.org", "9" * 50_000, "@" * 20_000, "+1" * 5_000, "1.2.3.4" + "x" * 100_000, "é 😀 me@x.org"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = {r.doc_id: r for r in pii.find(docs).collect()}
    assert len(rows) == len(texts)
    assert rows[0].base_sha256 == rows[1].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[0].spans == ""
    assert rows[2].spans == rows[3].spans == "email:0:8" and rows[8].spans == "email:4:12"
    assert rows[7].n_ip == 1
    redacted = pii.redact(docs)
    assert redacted.schema == docs.schema
    assert {r.doc_id: r.text for r in redacted.collect()}[2] == "[EMAIL]"
    assert pii.find(docs.limit(0)).count() == 0


def test_long_runs_of_every_kind_of_character():
    """Runs of thousands of one character, alone and between identifiers, end and agree with the plain patterns."""
    random.seed(7)
    pieces = ["0", "1", "9", "a", "é", " ", ".", "-", "+", "@", "(", "４", "\u200b", "а", "one ", "zwei-", "dot ", " at ", "[at]", "1.", "0.", "4 ", "a.", "\n", "😀"]
    for piece in pieces:
        for n in (40, 5000):
            for text in (piece * n, "1.2.3." + piece * n + "1", "+4930 " + piece * n, "x@y." + piece * n, piece * n + "@b.de", "4111 1111 1111 1111" + piece * n):
                base, more = pii.scan(text)
                if n == 40:
                    assert base == brute(text)
                assert all(0 <= s < e <= len(text) for s, _, e in [*base, *more])
    assert pii.scan("1.2.3." + "0" * 5000 + "1")[0] == [(0, 1, 5007)]
    assert pii.scan("1.2.3." + "0" * 5000)[0] == [(0, 1, 5006)]


def test_random_texts_end_without_an_error():
    random.seed(8)
    words = ["one", "zwei", "dot", "at", "plus", "dash", "1.2.3.4", "0000", "255", "256", "a@b.c", "4111", "+49", "(0)", "\u200b", "а", "４", "[dot]", "{at}", "is", "home", "it"]
    for i in range(30_000):
        text = "".join(random.choice(words) + random.choice(["", " ", ".", "-", " . "]) for _ in range(random.randint(0, 14)))
        base, more = pii.scan(text)
        assert all(0 <= s < e <= len(text) for s, _, e in [*base, *more])
        if i % 10 == 0:
            assert base == brute(text)
            pii.redacted(text)
