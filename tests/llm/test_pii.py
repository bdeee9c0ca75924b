import re
from collections import Counter
from pathlib import Path

import pytest

from quern.llm import pii

GIVEN, FAMILY = {"Velia", "Oswin", "Petra", "Noor", "Hesper"}, {"Tornquay", "Astermoor", "Reed", "Hunter", "Dvořálek"}
SCHEMA = "id long, body string, log_id long, pii_type string"


@pytest.fixture(scope="module")
def model():
    names = pii.Names(GIVEN, FAMILY, {"Zelda"}, {"Umberleigh"})
    return names, pii.trained(pii.Names(GIVEN, FAMILY))


CASES = [
    ("cc Velia Reed <a.b+c@mail.x.example> on it.", [("name", "Velia Reed"), ("email", "a.b+c@mail.x.example")]),
    ("to=a_b%2Bc%40x.example&ref=1", [("email", "a_b%2Bc%40x.example")]),
    ("no seat for ab [at] mail [dot] x [dot] test in it", [("email", "ab [at] mail [dot] x [dot] test")]),
    ("Send it to AB AT X DOT TEST now", [("email", "AB AT X DOT TEST")]),
    ("Clone git@forge.example:a/b.git and ssh deploy@10.12 or @a/b@1.0.1", []),
    ("reach me on +44 (0)20 7946 0443 or 0049 30 23125 518", [("phone", "+44 (0)20 7946 0443"), ("phone", "0049 30 23125 518")]),
    ("call (415) 555-0136, 1-415-555-0196 or 808.555.0163.", [("phone", "(415) 555-0136"), ("phone", "1-415-555-0196"), ("phone", "808.555.0163")]),
    ("Téléphone : 0049 30 23125 327 2024-05-18T11:17:44.610Z and +44 7700 900143 3e5f or +33 1 99 00 18 23 302", [("phone", "0049 30 23125 327"), ("phone", "+44 7700 900143"), ("phone", "+33 1 99 00 18 23 302")]),
    ("order no. 4820-3260-17 at 09:15:17474, version 2.415.555, build 20260114-1362", []),
    ("Verify SSN 921-49-5141 and Passport No: K8940969 and DNI 00420118-T", [("id_number", "921-49-5141"), ("id_number", "K8940969"), ("id_number", "00420118-T")]),
    ("deliveries go to Flat 11, 155 Ash Hollow Ave — ask for REED, Noor", [("address", "Flat 11, 155 Ash Hollow Ave"), ("name", "REED, Noor")]),
    ("address: 112 Kelm\nAvenue, or 49, rue de Harrowgate for now, Calle de Vetch 221, Millgasse 142", [("address", "112 Kelm\nAvenue"), ("address", "49, rue de Harrowgate"), ("address", "Calle de Vetch 221"), ("address", "Millgasse 142")]),
    ("The Reed Filter and the Hunter Queue skip 12 rows; thanks, Petra — it works", []),
    ("Read Main Street Parser; retry 3 Way Merge and 7 Lane Split", []),
    ("# reviewed by O. Dvořálek, d92edc6 and Petra M. Reed-Hunter", [("name", "O. Dvořálek"), ("name", "Petra M. Reed-Hunter")]),
    ("zelda umberleigh pinged me; Customer H. Umberleigh too", [("name", "zelda umberleigh"), ("name", "H. Umberleigh")]),
    ("Oswin Astermoor pinged me about it.", [("name", "Oswin Astermoor")]),
    ("", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(model, text, want):
    names, field = model
    assert [(k, text[s:e]) for s, e, k in field.find(text, names)] == want


#: Sentences that stand neither in the training set nor in the test tables.
HELD_OUT = [
    "Yesterday {name} told us that {thing} is ready.", "Contact person: {name}, {phone}", "The visit to {address} is on Tuesday.", "Please forward this to {email}, not to {email}.", "passenger {name}, document {id}, seat {n}", "Their office moved from {address}.",
    "{{\"reviewer\": \"{name}\", \"notify\": [\"{email}\"]}}", "If {phone} is busy, try {phone}.", "Nobody but {name} knows {thing}.", "Signed by {name} in {address}", "VALUES ('{name}', '{phone}', '{id}')", "to whom it may concern: {id} is {name}", "wrote {email} and {name} about it", "mein Kollege {name}, {email}",
]
HELD_OUT_DECOYS = [
    "fetch git@{host}:{word}/{word} at {hash}", "The {family} {Noun} calls {Noun} {Noun} {n} times.", "release {d}.{d}{d}.{d} of {word}@{d}.{d}.{d}", "job {n4} of ticket QQ-{n4} ran {n} s", "thank you {given}, {thing} works", "{Verb} the {Noun} in Room {n}", "host {word}.{word} port {n4}", "{n4}-0{d}-1{d} {n} rows, {n4} errors", "ssh root@10.{d}.{d}.{n} hangs",
]


def test_sentences_seen_neither_in_training_nor_in_the_data(model):
    """Precision and recall of each type, with names that are listed, common, told of by the texts, or known to nobody."""
    _, field = model
    names, _, _ = pii.training_names(pii.Names(GIVEN, FAMILY), 77)
    hit, extra, missing = Counter(), Counter(), Counter()
    for text, real in pii.made_texts(pii.Names(GIVEN, FAMILY), 1500, 77, HELD_OUT, HELD_OUT_DECOYS):
        got = {(s, k) for s, _, k in field.find(text, names)}
        for many, of in ((hit, got & real), (extra, got - real), (missing, real - got)):
            many.update(k for _, k in of)
    figures = {k: (round(hit[k] / (hit[k] + extra[k]), 3), round(hit[k] / (hit[k] + missing[k]), 3)) for k in pii.TYPES}
    print(figures)
    assert min(min(f) for f in figures.values()) >= 0.9, figures


def test_frames_do_not_stand_in_the_test_tables():
    path = Path("/root/testdata/sf0.001/logs.parquet")
    if not path.exists():
        pytest.skip("no test tables here")
    import pyarrow.parquet as pq

    bodies = "\n".join(b for b in pq.read_table(path, columns=["body"]).column(0).to_pylist() if b)
    for frame in [*pii.CARRIERS, *pii.DECOYS, *HELD_OUT, *HELD_OUT_DECOYS]:
        fixed = [p for p in re.split(r"\{\{|\}\}|\{\w+\}", frame) if len(p.split()) >= 2 and len(p) > 8]
        assert not fixed or not all(p in bodies for p in fixed), frame


def test_names_of_which_a_part_is_in_no_list(model):
    names, field = model
    for text, want in [("Yesterday John Smith told us about it.", "John Smith"), ("I spoke with Maria Gonzalez today", "Maria Gonzalez"), ("met Velia Aggerly", "Velia Aggerly")]:
        assert [text[s:e] for s, e, _ in field.find(text, names)] == [want]


def test_distant_repeats_agree(model):
    """A skip edge carries the label of a clear mention to an unclear one, whatever lies between."""
    names, field = model
    weights = {"clear": 6.0, "unclear": -0.5}
    node = lambda at, f: pii.Candidate(at, at + 5, "name", "reed", [f])
    alone = pii.Field(weights, 0.0, 2.0).marginals([node(5000, "unclear")])
    both = pii.Field(weights, 0.0, 2.0).marginals([node(0, "clear"), node(5000, "unclear")])
    assert alone[0] < 0 < both[1]


def test_tables(spark):
    rows = [(i, f"Ask Zelda {f} before {i}. met {g} Umberleigh", 1, "x") for i, (f, g) in enumerate([(f, g) for f in ("Tornquay", "Astermoor", "Hunter") for g in GIVEN])]
    rows += [(100, None, 1, "x"), (101, "", 1, "x"), (102, "x" * 200_000 + " Velia Reed", 1, "x"), (3, rows[3][1], 1, "x"), (None, "Velia Reed", 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    parts = spark.createDataFrame([(g, "given") for g in GIVEN] + [(f, "family") for f in FAMILY] + [(None, "given")], "name_part string, name_role string")
    found = pii.found(df, parts).collect()
    assert {(r.log_id, r.pii_type, r.span_start) for r in found if r.log_id == 102} == {(102, "name", 200_001)}
    for i, body, *_ in rows[:15]:
        assert {r.span_start for r in found if r.log_id == i} == {body.index("Zelda"), body.index("met ") + 4}, body
    out = pii.redacted(df, parts).collect()
    assert len(out) == len(rows)
    assert {r.body for r in out if r.id == 100} == {None} and {r.body for r in out if r.id == 101} == {""}
    assert next(r.body for r in out if r.id == 0) == "Ask [NAME] before 0. met [NAME]"
    assert pii.found(df.limit(0), parts).count() == 0
    assert pii.found(df, parts.limit(0)).count() >= 0
