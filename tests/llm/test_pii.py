import pytest

from palimpsest.llm import pii

GIVEN, FAMILY = ["grace", "thomas", "maria", "may", "hope", "rené", "clement"], ["hesbadham", "zushokham", "bolmekham", "o'linvar"]


@pytest.fixture(scope="module")
def machine():
    return pii.automaton({**dict.fromkeys(FAMILY, "F"), **dict.fromkeys(GIVEN, "G")})


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ("Write to a.b+c@mail.example now", [("email", "a.b+c@mail.example")]),
        ("x [at] post [dot] test or y@post.test", [("email", "x [at] post [dot] test"), ("email", "y@post.test")]),
        ("j.doe at office.example, please", [("email", "j.doe at office.example")]),
        ("icon@2x.png and lib-1@3.1.0, deploy@build-1:/srv", []),
        ("Call +44 (0)161 496 0718 or (555) 555-0198 or 030/23125146.", [("phone", "44 (0)161 496 0718"), ("phone", "555) 555-0198"), ("phone", "030/23125146")]),
        ("Serial 555-10-0199-22, invoice 2025-019-7741, host 10.4.10.7 on 2025-03-14 at 10:30", []),
        ("my id: SSN 950 42 5091 and DNI 00417239L, QQ 80 25 41 A", [("id_number", "950 42 5091"), ("id_number", "00417239L"), ("id_number", "QQ 80 25 41 A")]),
        ("to 12630 N Station St, Apt 5B; Mühlgasse 173 b, 00777 Ort; Calle del Almendro 29; 125 rue des Orfèvres", [("address", "12630 N Station St"), ("address", "Mühlgasse 173 b"), ("address", "Calle del Almendro 29"), ("address", "125 rue ")]),
        ("Orchard Street is closed on 19 January. The Chapel Road market opens.", []),
        ("Dr. Grace Hesbadham met M. Bolmekham and thomas zushokham", [("name", "Grace Hesbadham"), ("name", "M. Bolmekham"), ("name", "thomas zushokham")]),
        ("May is dry. Hope the box fits. The grace period ends. Tessel, please.", []),
        ("Did May reply about it? Lunch with Hope at 9:30.", [("name", "May"), ("name", "Hope")]),
        ("Mr Garhadson left. Zolvudan told me the pump is old.", [("name", "Garhadson"), ("name", "Zolvudan")]),
        ("Prof. Dr. Garhadson left", [("name", "Garhadson")]),
        ("MARIA’s list, René", [("name", "MARIA"), ("name", "René")]),
        ("see tel:0161-4960718 or tel:+441614960718", [("phone", "0161-4960718"), ("phone", "441614960718")]),
        ("my passport 12-34 55 66 7", [("id_number", "12-34 55 66 7")]),
        ("mail mailto:a.b@c.example!", [("email", "a.b@c.example")]),
        ("P.O. Box 170, Garmouth Hill", [("address", "P.O. Box 170")]),
        ("", []),
    ],
)
def test_items(machine, text, items):
    found = [(k, text[a:b].lstrip("+( ")) for k, a, b in pii.find_items(text, machine)]
    assert [x[0] for x in found] == [x[0] for x in items]
    for (_, got), (_, want) in zip(found, items, strict=True):
        assert got == want or got.startswith(want) or want.startswith(got)


def test_whole_texts_and_odd_letters(machine):
    text = "İ" * 30 + " no " * 20_000 + "a@b.example"
    assert [x[:2] for x in pii.find_items(text, machine)] == [("email", text.index("a@b"))]


def test_tables(spark, rows):
    windows = spark.createDataFrame([("w1", "Ask Grace Hesbadham or g@x.test", "k"), ("w1", "Ask Grace Hesbadham or g@x.test", "k"), ("w2", None, "k"), ("w3", "", "k")], "id string, text string, kind string")
    actions = spark.createDataFrame([("a1", "Call 07700 900547"), ("a2", None)], "id string, request_text string")
    entities = spark.createDataFrame([("e", "Grace Hesbadham", "person", None), ("f", "Grace Zushokham", "person", "the boss"), (None, None, None, None)], "id string, name string, type string, aliases string")
    both = pii.texts(windows, actions)
    names = pii.all_name_parts(entities, both)
    assert {(r.part, r.role) for r in names.where("part in ('grace', 'hesbadham', 'zushokham')").collect()} == {("grace", "G"), ("hesbadham", "F"), ("zushokham", "F")}
    want = [("actions", "a1", "phone", 5), ("windows", "w1", "email", 23), ("windows", "w1", "name", 4)]
    assert rows(pii.scan(both, names), "source_table", "row_id", "kind", "start_pos") == want
    few = names.where("part in ('grace', 'hesbadham', 'zushokham', 'maria')")
    for size in (1000, 2, 1):  # in one pass, and in passes of a name or two
        assert rows(pii.scan(both, few, size), "source_table", "row_id", "kind", "start_pos") == want
        texts = {r.row_id: r.text for r in pii.redacted(both, few, size).collect()}
        assert texts["w1"] == "Ask [NAME] or [EMAIL]" and texts["a1"] == "Call [PHONE]" and texts["w3"] == ""
    assert pii.scan(both.where("false"), names).count() == 0
    by_block = {r.part for r in pii.all_name_parts(entities, both, size=40).collect()}
    assert by_block == {r.part for r in names.collect()}


def test_nothing_without_anchors(machine):
    """Parsers start at anchors only: an automaton without the marks of a kind finds none of it."""
    import ahocorasick

    text = "Write to a.b@mail.example, call 0161 496 0718 or ask at 12630 N Station St, DNI 00417239L"
    kinds = {k for k, _, _ in pii.find_items(text, machine)}
    assert kinds == {"email", "phone", "address", "id_number"}
    for mark, lost in (("@", {"email"}), ("0123456789", {"phone", "id_number", "address"})):
        bare = ahocorasick.Automaton()
        for word, (k, n) in machine.items():
            if word not in mark:
                bare.add_word(word, (k, n))
        bare.make_automaton()
        assert not lost & {k for k, _, _ in pii.find_items(text, bare)}
