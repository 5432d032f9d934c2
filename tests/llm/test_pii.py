import pytest

from strataline.llm import pii

LEXICON = [("ada", True, False), ("rose", True, False), ("will", True, False), ("jörg", True, False), ("lindqvist", False, True), ("o'hara", False, True), ("berg", False, True)]


@pytest.fixture(scope="module")
def find():
    finder = pii.Finder(LEXICON)
    return lambda t: [(k, t[a:b]) for a, b, k in finder(t)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Dear Ada Lindqvist, hello", [("name", "Ada Lindqvist")]),
        ("Please call Lindqvist, Ada now", [("name", "Lindqvist, Ada")]),
        ("Dr. Ada van der Berg came", [("name", "Ada van der Berg")]),
        ("A. O'Hara and ADA LINDQVIST", [("name", "A. O'Hara"), ("name", "ADA LINDQVIST")]),
        ("it will rise and the rose is red", []),
        ("Hi Will,\n\nthe rest", [("name", "Will")]),
        ("write to ada.lindqvist@mail.example.org today", [("email", "ada.lindqvist@mail.example.org")]),
        ("a_b+c(at)example.org or x [at] example [dot] net", [("email", "a_b+c(at)example.org"), ("email", "x [at] example [dot] net")]),
        ("the placeholder user@host stays", []),
        ("name @ example.com", [("email", "name @ example.com")]),
        ("+1 (202) 555-0110, 030/23125-892; 01.99.00.20.34", [("phone", "+1 (202) 555-0110"), ("phone", "030/23125-892"), ("phone", "01.99.00.20.34")]),
        ("Build 12.0.179, rule 7-384-2024, batch 2024-01-809-88, ticket 4821-33-279", []),
        ("SSN on file: 949-28-3413", [("id_number", "949-28-3413")]),
        ("Checksum 0082019934417 did not match", []),
        ("national id 38220981204, phone 555-0160", [("id_number", "38220981204"), ("phone", "555-0160")]),
        ("QQ 50 01 45 C belongs to", [("id_number", "QQ 50 01 45 C")]),
        ("Ship to 55 Old Mill Rd, Kilburn 48342", [("address", "55 Old Mill Rd, Kilburn 48342")]),
        ("in der Unterkunft Alte Webergasse 171, 74157 Altenfeld", [("address", "Alte Webergasse 171, 74157 Altenfeld")]),
        ("au 12 bis rue des Lilas, 75000 X", [("address", "12 bis rue des Lilas, 75000 X")]),
        ("vive en Calle de los Olmos 133, bajo", [("address", "Calle de los Olmos 133, bajo")]),
        ("Marrow Bay 77 is the name of a meeting room", []),
        ("it takes 15 ms. Under load", []),
    ],
)
def test_occurrences(find, text, want):
    assert find(text) == want


def test_placeholders_leave_the_rest_unchanged():
    finder = pii.Finder(LEXICON)
    text = "Hi Ada,\ncall +1-646-555-0101 or mail ada@x.example now."
    assert pii.redact(text, finder(text)) == "Hi [NAME],\ncall [PHONE] or mail [EMAIL] now."


def test_lexicon_and_operators(spark):
    text = "From: Zelda Quist <zelda.quist@x.example>\nQuist, Mona <mona_quist@x.example>\nDear Zelda Quist,"
    df = spark.createDataFrame([("a", text, 1), ("a", text, 1), ("b", None, 2), ("c", "", 3)], "key string, text string, kind int")
    lexicon = pii.name_lexicon(df)
    assert {t for t, _, _ in lexicon} >= {"zelda", "quist", "mona"}
    found = {tuple(r) for r in pii.find_personal(df, lexicon, "key", "text").collect()}
    assert ("a", "name", 7) in found and ("a", "email", 20) in found and ("a", "name", text.index("Dear") + 6) in found
    clean = {r.record_id: r.text for r in pii.redact_personal(df, lexicon, "key", "text").collect()}
    assert clean["b"] is None and clean["c"] == "" and "uist" not in clean["a"]
    assert pii.name_lexicon(df.limit(0)) == [] and pii.find_personal(df.limit(0), [], "key", "text").count() == 0


def test_characters_that_grow_in_lower_case(find):
    assert find("İİ Dear Ada Lindqvist, x") == [("name", "Ada Lindqvist")]


HAND = [
    ("Pay to IBAN DE89 3704 0044 0532 0130 00 today.", "Pay to IBAN [ACCOUNT] today."),
    ("IBAN GB82 WEST 1234 5698 7654 32 ok", "IBAN [ACCOUNT] ok"),
    ("Card 4111 1111 1111 1111 was used.", "Card [ACCOUNT] was used."),
    ("Card 4111 1111 1111 1112 is mistyped.", "Card 4111 1111 1111 1112 is mistyped."),
    ("Keplerstraße 5, 10115 Berlin, and more.", "[ADDRESS], and more."),
    ("1600 Pennsylvania Avenue NW, Washington, DC 20500 is known.", "[ADDRESS] is known."),
    ("He lives at 10 Downing Street, London SW1A 2AA.", "He lives at [ADDRESS]."),
    ("C/ Mayor 12, 3º B, 28013 Madrid es.", "[ADDRESS] es."),
    ("12 rue de la Paix, 75002 Paris, merci", "[ADDRESS], merci"),
    ("Via Roma 12, 00184 Roma is old.", "[ADDRESS] is old."),
    ("Send it to P.O. Box 123, Springfield 12345.", "Send it to [ADDRESS]."),
    ("Call 555-010-1234 ext. 12 now.", "Call [PHONE] now."),
    ("Maria Gonzalez wrote the plan and John Baker agreed.", "[NAME] wrote the plan and [NAME] agreed."),
    ("x" * 70 + "@example.org wrote.", "[EMAIL] wrote."),
    ("see https://bob@example.org/x", "see https://bob@example.org/x"),
    ("Ann Lee, 72600982886, came", "[NAME], [ID_NUMBER], came"),
    ("Order 202400123456 is late, build 12.0.592 too.", "Order 202400123456 is late, build 12.0.592 too."),
    ("Her SSN is 123-45-6789.", "Her SSN is [ID_NUMBER]."),
    ("Rows:\n12\n345\n678\n901\n", "Rows:\n12\n345\n678\n901\n"),
]


@pytest.mark.parametrize("text,want", HAND)
def test_redacted_sentences(text, want):
    search = pii.Finder([("ann", True, False), ("lee", False, True)])
    assert pii.redact(text, search(text)) == want


def test_a_lexicon_too_large_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(pii, "LEXICON_TOKENS", 1)
    rows = [("Ann Lee <ann.lee@example.org>",), ("Bob Roe <bob.roe@example.org>",)]
    with pytest.raises(ValueError):
        pii.name_lexicon(spark.createDataFrame(rows, "text string"))
