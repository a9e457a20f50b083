import pytest

from granary.llm.pii import Model, Normal, find_spans, learn, personal_information, redact

LEX = [("Mirito", "given"), ("Pippin", "given"), ("Rose", "given"), ("Kremamuro", "family"), ("Winter", "family"), ("Larkeld", "family"), ("Gold", "family"), ("de Quinoa", "family"), ("Maskeld", "family"), ("", "given"), (None, "family")]


@pytest.fixture(scope="module")
def lexicon():
    return Model([*LEX, ("port selby", "town"), ("upper tarn", "town"), *((w, "common") for w in "the and was fruit please noon before sheet about labels is now".split())])


CASES = [
    ("Write to a.b+c@mail.growers.example, please", [("email", "a.b+c@mail.growers.example")]),
    ("x <a_b (at) imaging (dot) lab (dot) test>.", [("email", "a_b (at) imaging (dot) lab (dot) test")]),
    ("mail a-b AT lab DOT test before six", [("email", "a-b AT lab DOT test")]),
    ("or a9[at]lab[dot]test", [("email", "a9[at]lab[dot]test")]),
    ("a.b @ lab.test", [("email", "a.b @ lab.test")]),
    ("version hsv@4 stayed at 33.9 dot", []),
    ("called from +999 52 55 50 10 07.", [("phone", "+999 52 55 50 10 07")]),
    ("Ring +999 (61) 555 0130 ext. 66 or", [("phone", "+999 (61) 555 0130 ext. 66")]),
    ("T: 065 / 555 0116", [("phone", "065 / 555 0116")]),
    ("tel. (845) 555-0125.", [("phone", "(845) 555-0125")]),
    ("My number is 0595550176, ask", [("phone", "0595550176")]),
    ("call five five five oh one two three now", [("phone", "")]),
    ("lot 2794-5613, EAN 9993111434754, SN735236189, #20668, 10.9.26.55, 23:27-21:16, 12/5/26", []),
    ("Her passport is QZ 84 96 88 B and", [("id_number", "QZ 84 96 88 B")]),
    ("Tax ID: 8230 8054 6006\n| x", [("id_number", "8230 8054 6006")]),
    ("Social security no. 43549293792 belongs", [("id_number", "43549293792")]),
    ("Ausweisnummer 37.978.316-K stand", [("id_number", "37.978.316-K")]),
    ("lot 972 28 4745 is late", []),
    ("Deliver to Flat 12, 6 Old Quay Lane, Obermarrow.", [("address", "Flat 12, 6 Old Quay Lane, Obermarrow")]),
    ("at 12B Miller's Drive\nObermarrow ZQ6 7QZ.\nNext", [("address", "12B Miller's Drive\nObermarrow ZQ6 7QZ")]),
    ("at 40 rue du Verger, 00703 Port Selby.", [("address", "40 rue du Verger, 00703 Port Selby")]),
    ("in Kelterstraße 76, 00998 Fenwick Hollow, yes", [("address", "Kelterstraße 76, 00998 Fenwick Hollow")]),
    ("P.O. Box 894, Upper Tarn. Early", [("address", "P.O. Box 894, Upper Tarn")]),
    ("Ask Mirito Kremamuro about the labels.", [("name", "Mirito Kremamuro")]),
    ("Ask Xyl Zzyzx about the labels.", [("name", "Xyl Zzyzx")]),
    ("I met Kremamuro, Mirito at dock C.", [("name", "Kremamuro, Mirito")]),
    ("MRS MIRITO B. KREMAMURO HAS MOVED", [("name", "MIRITO B. KREMAMURO")]),
    ("Dr. Mirito van der Krem signed", [("name", "Mirito van der Krem")]),
    ("Kind regards,\nM. Kremamuro\nMaskeld Orchards", [("name", "M. Kremamuro")]),
    ("Mirito Kremamuro wrote that", [("name", "Mirito Kremamuro")]),
    ("Winter Larkeld fruit from Maskeld Orchards; the Pippin crates; Belten Gold; share rose to 9", []),
    ("Mirito​ Kremamuro is here", [("name", "Mirito​ Kremamuro")]),
]


@pytest.mark.parametrize("text, want", CASES)
def test_cases(text, want, lexicon):
    got = [(k, text[a:b]) for a, b, k in find_spans(text, lexicon)]
    if want == [("phone", "")]:
        want = []  # seven spelled digits without a prefix are no phone
    assert got == want


WORDINGS = [
    ("We saw Xavia Kremamuro near the dock.", [("name", "Xavia Kremamuro")]),
    ("Xavia Kremamuro", []),
    ("crates of Wintre Larkeld and Winer Larkeld", []),
    ("Crates from Frau Kremamuro, Orchards Kremamuro, Belten Gold and the Xavia Kremamuro Orchards", []),
    ("see KISTE KREMAMURO here", []),
    ("an ana arroba lab punto test schreiben", [("email", "ana arroba lab punto test")]),
    ("mail ana at lab point growers point test, please", [("email", "ana at lab point growers point test")]),
    ("ana punkt lopez @ lab punkt test", [("email", "ana punkt lopez @ lab punkt test")]),
    ("en ana (arroba) lab punto test", [("email", "ana (arroba) lab punto test")]),
    ("ana@lab punto test", [("email", "ana@lab punto test")]),
    ("At this point Mirito Kremamuro met us at dock C, the point of it", [("name", "Mirito Kremamuro")]),
    ("For my part +999 52 55 50 10 07 is best", [("phone", "+999 52 55 50 10 07")]),
    ("about that order: (845) 555-0125.", [("phone", "(845) 555-0125")]),
    ("ticket 845 555 0125 ext. 66", [("phone", "845 555 0125 ext. 66")]),
    ("ticket 845-555-0125, lot 0595550176", []),
]


@pytest.mark.parametrize("text, want", WORDINGS)
def test_wordings_of_other_documents(text, want, lexicon):
    assert [(k, text[a:b]) for a, b, k in find_spans(text, lexicon)] == want


def test_offsets_map_back():
    raw = "а​b (at) ｃ.test and one two three four five six seven"
    n = Normal(raw)
    assert n.text.startswith("ab@c.test") and n.text.endswith("1234567")
    a = n.text.index("ab@c.test")
    assert raw[slice(*n.source(a, a + 9))] == "а​b (at) ｃ.test"
    b = n.text.index("1234567")
    assert raw[slice(*n.source(b, b + 7))] == "one two three four five six seven"
    assert Normal("plain text").source(2, 5) == (2, 5)


def test_redaction_leaves_the_rest(lexicon):
    text = "Ask Mirito Kremamuro about the labels.\r\n a@b.test "
    s = find_spans(text, lexicon)
    assert redact(text, s) == "Ask [NAME] about the labels.\r\n [EMAIL] "
    assert redact("", []) == ""


def test_frames(spark):
    docs = spark.createDataFrame([(1, "a@b.test and a@b.test", "k"), (2, None, "k"), (3, "", "k"), (None, "T: 065 / 555 0116", "k"), (4, "x " * 20_000 + "a@b.test", "k")], "doc_id bigint, text string, kind string")
    lex = spark.createDataFrame(LEX, "token string, kind string")
    got = {tuple(r) for r in personal_information(docs, "doc_id", "text", lex).collect()}
    assert got == {(1, "email", "a@b.test"), (None, "phone", "065 / 555 0116"), (4, "email", "a@b.test")}
    red = {r.doc_id: r.text for r in personal_information(docs, "doc_id", "text", lex, replace=True).collect()}
    assert red[1] == "[EMAIL] and [EMAIL]" and red[2] is None and red[3] == "" and red[None] == "T: [PHONE]"
    assert personal_information(docs.limit(0), "doc_id", "text", lex.limit(0)).count() == 0


#: Families, towns and wordings that no test table has: text, then every piece of it.
ELSEWHERE = [
    ("Please forward it to Anna Kowalczyk before noon.", [("name", "Anna Kowalczyk")]),
    ("Our buyer Anna Kowalczyk confirmed.", [("name", "Anna Kowalczyk")]),
    ("Yours truly,\nAnna Kowalczyk", [("name", "Anna Kowalczyk")]),
    ("Sincerely yours,\nJohn Smith", [("name", "John Smith")]),
    ("Viele Grüße\nJonas Brinkmann\n", [("name", "Jonas Brinkmann")]),
    ("Un saludo,\nMaría José Echevarría", [("name", "María José Echevarría")]),
    ("Mrs Ifeoma Nwosu has the keys.", [("name", "Ifeoma Nwosu")]),
    ("Herr Dr. Klaus von der Heyde kommt.", [("name", "Klaus von der Heyde")]),
    ("We thank the inspector Piotr K. Nowacki for this.", [("name", "Piotr K. Nowacki")]),
    ("Yesterday I met Chidi Okonkwo.", [("name", "Chidi Okonkwo")]),
    ("A note from Sofia Lindqvist, thanks", [("name", "Sofia Lindqvist")]),
    ("Nous avons parlé avec Amélie Rousseau.", [("name", "Amélie Rousseau")]),
    ("Hello Pat Obrien,\nthe trays are late", [("name", "Pat Obrien")]),
    ("-- \nHana Suzuki | hana@kiku.example", [("name", "Hana Suzuki"), ("email", "hana@kiku.example")]),
    ("Lars Holmberg\n12 Mill Lane, Ashcombe\n", [("name", "Lars Holmberg"), ("address", "12 Mill Lane, Ashcombe")]),
    ("The driver: Tomasz Zielinski.", [("name", "Tomasz Zielinski")]),
    ("Hauptstr. 5, 10115 Berlin", [("address", "Hauptstr. 5, 10115 Berlin")]),
    ("Via Roma 12, 20121 Milano", [("address", "Via Roma 12, 20121 Milano")]),
    ("Keizersgracht 123, 1015 Amsterdam", [("address", "Keizersgracht 123, 1015 Amsterdam")]),
    ("write to 7 Elm Grove, New Haven.", [("address", "7 Elm Grove, New Haven")]),
    ("at 44 rue de la Paix, 75002 Paris now", [("address", "44 rue de la Paix, 75002 Paris")]),
    ("Calle Mayor 3, 28013 Madrid", [("address", "Calle Mayor 3, 28013 Madrid")]),
    ("identity number 8001015009087", [("id_number", "8001015009087")]),
    ("Her passport number is L898902C3 today", []),
    ("Carte d'identité: 880692310285", [("id_number", "880692310285")]),
    ("Bosch Kitchen and Royal Gala from Delta Foods for the Bank of Kent", []),
    ("with the Excel Sheet and the Python Script", []),
    ("Meet us at Central Station before noon. Ask Support about the labels.", []),
    ("call +44 20 7946 0958 or (212) 555-0187", [("phone", "+44 20 7946 0958"), ("phone", "(212) 555-0187")]),
    ("j.doe [at] example [dot] org or jdoe@example.org", [("email", "j.doe [at] example [dot] org"), ("email", "jdoe@example.org")]),
]


def test_other_families_towns_and_wordings(lexicon):
    """Recall and precision on texts unlike the test tables, with a lexicon that has none of their names."""
    hits = wrong = total = 0
    for text, want in ELSEWHERE:
        got = [(k, text[a:b]) for a, b, k in find_spans(text, lexicon)]
        hits += len(set(got) & set(want))
        wrong += len(set(got) - set(want))
        total += len(want)
        if got != want:
            print(repr(text), got)
    print(hits, wrong, total)
    assert hits >= 0.9 * total and hits >= 0.9 * (hits + wrong)


def test_names_and_towns_are_learned_from_the_corpus(spark):
    texts = [f"The {w} tray is in place {i}." for i, w in enumerate(["red", "ripe", "dull", "small"] * 5)]
    texts += ["today Ulvara Kremamuro came", "so Ulvara Larkeld left", "Mirito Hesperov was here", "then Mirito Hesperov again", "Hesperov Growers ship", "at 5 Mill Lane, Nether Wold.", "at 6 Mill Lane, Nether Wold."]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "see ulvara hesperov at 9 mill lane, nether wold and the tray", None, ""])], "doc_id bigint, text string")
    lex = spark.createDataFrame(LEX, "token string, kind string")
    facts = {tuple(r) for r in learn(docs, "text", lex).collect()}
    assert {("ulvara", "given"), ("hesperov", "family"), ("nether wold", "town"), ("tray", "common"), ("mirito", "given")} <= facts
    assert not any(t in ("the", "tray", "place") and k != "common" for t, k in facts)
    got = {tuple(r) for r in personal_information(docs, "doc_id", "text", lex).collect()}
    assert {(27, "name", "ulvara hesperov"), (27, "address", "9 mill lane, nether wold"), (22, "name", "Mirito Hesperov")} <= got
    assert got == {tuple(r) for r in personal_information(docs, "doc_id", "text", lex, most_bytes=0).collect()}
