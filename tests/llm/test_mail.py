import base64
import quopri
import random

import pytest

from morphlake.llm.leakage import Hashes, bit_filter, leaks, myers, nearest, piece_words, words
from morphlake.llm.mail import text_parts, unquoted
from morphlake.llm.sentences import Model, eligible, items, learn, paragraphs, sentence_units, unit_ends

ITEM = "Our engine checked Mr. Arvello and their valve, and the northern refund repaired version 9.24.9 of every sensor? A narrow refund sorted their cheap engine."
PASSAGE = "their valve, and the northern refund repaired version 9.24.9 of every sensor?"  # 14 words


def mail(body, kind="text/plain", cte="8bit", nl="\n"):
    return f"From: a{nl}Content-Type: {kind};{nl} charset=utf-8{nl}content-transfer-encoding: {cte}{nl}{nl}{body}"


def b64(text):
    return base64.encodebytes(text.encode()).decode()


CARRIERS = {
    "plain": mail(f"So {PASSAGE} Yes."),
    "upper": mail(PASSAGE.upper()),
    "wrapped": mail(PASSAGE.replace(" ", "\n")),
    "crlf": mail(PASSAGE.replace(" ", "\r\n"), nl="\r\n"),
    "quoted": mail("> " + PASSAGE.replace(" ", "\n> > ")),
    "base64": mail(b64("Привет " + PASSAGE), cte="base64"),
    "cut base64": mail(b64(PASSAGE + " and more " * 9)[:-9], cte="BASE64"),
    "qp": mail(quopri.encodestring(("Ж " + PASSAGE).encode()).decode(), cte="quoted-printable"),
    "html": mail("<html><body><p>" + PASSAGE.replace("valve", "<b>val</b>ve").replace(" of ", "<br>\nof ").replace(",", "&#44;") + "</p></body></html>", "text/html"),
    "parts": f'From: a\nContent-Type: multipart/mixed; boundary="b=1"\n\n--b=1\n\nplain\n--b=1\nContent-Type: text/plain; name="n.txt"\nContent-Disposition: attachment\nContent-Transfer-Encoding: base64\n\n{b64(PASSAGE)}--b=1--\n',
    "cut off": f"From: a\nContent-Type: multipart/alternative; boundary=xx\n\n--xx\nContent-Type: text/html\n\n<p>{PASSAGE}",
}
OTHERS = {"image": f"From: a\nContent-Type: image/png\n\n{PASSAGE}", "short": mail(" ".join(PASSAGE.split()[:7])), "headers only": f"Subject: {PASSAGE}", "empty": "", "hidden": mail(f"<style>{PASSAGE}</style>x", "text/html")}


def test_carriers(spark):
    texts = [*CARRIERS.values(), *OTHERS.values(), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 as item_id", "2 as hash")
    held = spark.createDataFrame([(7, ITEM), (8, None), (9, "too short"), (10, "")], "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in leaks(docs.unionByName(docs), held).where("distance = 0").collect()) == [(i, 7) for i in range(len(CARRIERS))]
    assert leaks(docs, held.limit(0)).count() == 0 and leaks(docs.limit(0), held).count() == 0
    assert unquoted(">> a\n> b\n|c") == "a\nb\nc" and text_parts("no empty line") == []


def edit(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        prev, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(prev[j] + (x != y), prev[j + 1] + 1, row[j] + 1))
    return min(row)


def test_myers_against_table():
    rng = random.Random(5)
    for _ in range(300):
        a = [rng.choice("abc") for _ in range(rng.randint(1, 12))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 20))]
        assert myers(a, b, 99) == edit(a, b)
        assert myers(a, b, 1) == min(edit(a, b), 2)


def wrong(rng, passage, errors):
    """The passage with so many words replaced, left out or added."""
    out = list(passage)
    for k in sorted(rng.sample(range(1, len(out) - 1), errors), reverse=True):
        out[k : k + 1] = rng.choice([["wrong"], [], [out[k], "added"]])
    return out


@pytest.mark.parametrize("errors", [0, 1, 2])
def test_leaks_against_brute_force(spark, errors):
    rng = random.Random(errors)
    held = {i: [f"w{rng.randrange(400)}" for _ in range(rng.randint(5, 40))] for i in range(40)}
    docs = {}
    for i in range(160):
        doc = [f"w{rng.randrange(400)}" for _ in range(rng.randint(0, 30))]
        for _ in range(rng.choice([0, 1, 1, 3])):
            item = held[rng.randrange(40)]
            n = rng.choice([7, 11, 12, 15])
            a = rng.randrange(max(1, len(item) - n))
            if len(item[a : a + n]) > 4:
                doc[len(doc) // 2 : len(doc) // 2] = wrong(rng, item[a : a + n], rng.choice([0, 1, 2, 3]))
        docs[i] = doc

    def least(item, doc):
        return min((edit(item[a : a + 12], doc) for a in range(len(item) - 11)), default=99)

    want = {(d, i): n for d, doc in docs.items() for i, item in held.items() if (n := least(item, doc)) <= errors}
    frame = lambda rows, name: spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], f"{name} bigint, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in leaks(frame(docs, "doc_id").repartition(3), frame(held, "item_id"), 12, errors).collect()}
    assert not got  # no message has a body
    got = {(r.doc_id, r.item_id): r.distance for r in leaks(spark.createDataFrame([(i, "H: x\n\n" + " ".join(w)) for i, w in docs.items()], "doc_id bigint, text string"), frame(held, "item_id"), 12, errors).collect()}
    assert got == want and {*want.values()} == {*range(errors + 1)}
    assert piece_words(12, errors) == 13 // (errors + 2)
    assert nearest(held[0], ["x"], 12, 1) == 2


def test_the_filter_holds_every_piece(spark):
    own = [f"w{i}" for i in range(3000)]
    h = Hashes(4)(own)
    assert len(h) == 2997 == len(set(h.tolist())) and not len(Hashes(4)(own[:3]))
    held = spark.createDataFrame([(int(x),) for x in h.view("int64")], "hash bigint")
    from morphlake.llm.leakage import _places

    for k in (15, 18):
        bits = bit_filter(held, k)
        assert len(bits) == max(1 << k, 32_768) // 8
        for at in _places(h, k):
            assert all(bits[int(a) >> 3] >> (int(a) & 7) & 1 for a in at)
        other = _places(Hashes(4)([f"v{i}" for i in range(3000)]), k)
        both = [bits[int(a) >> 3] >> (int(a) & 7) & bits[int(c) >> 3] >> (int(c) & 7) & 1 for a, c in zip(*other)]
        assert sum(both) < (200 if k == 15 else 20)


def test_deep_parts():
    message = PASSAGE
    for i in range(300):
        message = f"Content-Type: multipart/mixed; boundary=b{i}x\n\n--b{i}x\n{message if i else chr(10) + message}"
    assert text_parts("From: a\n" + message) == ["\n" + PASSAGE]


EN = ({"dr": 0.0, "no": 0.0, "p.m": 1.0, "e.g": 0.0, "j": 0.0}, {"the", "our", "every", "that"}, {"mai"})
UNITS = [
    ("Hello Drosk,\n\nThe pump broke. It is near Dr. Quarne and No. 5? Yes!\n\nYours,\nJ. Quarne", ["Hello Drosk,", "The pump broke.", "It is near Dr. Quarne and No. 5?", "Yes!", "Yours,\nJ. Quarne"]),
    ('"Our pump!" replied Dr. Venn. He wrote: "The end." Our car', ['"Our pump!" replied Dr. Venn.', 'He wrote: "The end."', "Our car"]),
    ("At 4 p.m. Our van left. See 9.51. Every one... Well ... perhaps.", ["At 4 p.m.", "Our van left.", "See 9.51.", "Every one...", "Well ... perhaps."]),
    ("On Monday, Venn wrote:\n> Quoted. Text.\n> More.\nAnswer.Next one\n-- \nVenn. Signature.", ["On Monday, Venn wrote:", "Answer.", "Next one"]),
    ("1. One. Two.\n2. Three\nwrapped.\n3. Four", ["1. One. Two.", "2. Three\nwrapped.", "3. Four"]),
    ("Am 9. Mai kam er\n2. Mai ging er. Gut", ["Am 9. Mai kam er\n2. Mai ging er.", "Gut"]),
    ("« Le port ? » dit M. Torvek. « Oui. » Fin", ["« Le port ? » dit M. Torvek.", "« Oui. »", "Fin"]),
    ("¿Qué? —preguntó Venn. «¡Sí!», dijo.", ["¿Qué? —preguntó Venn.", "«¡Sí!», dijo."]),
    ("他说。“你好。”托维说。好", ["他说。", "“你好。”托维说。", "好"]),
    ("「行く！」とケソは言いました。「はい。」ver.6.40も……です。", ["「行く！」とケソは言いました。", "「はい。」", "ver.6.40も……です。"]),
    ("यह है। वह 5.5 था? हाँ", ["यह है।", "वह 5.5 था?", "हाँ"]),
    ("مرحبا بك؟ نعم. لا", ["مرحبا بك؟", "نعم.", "لا"]),
    ("the pump broke. it is near dr. quarne! why? yes", ["the pump broke.", "it is near dr. quarne!", "why?", "yes"]),
    ("\n\n***\n\n", []),
]


@pytest.mark.parametrize("nl", ["\n", "\r\n"])
def test_units(nl):
    for body, want in UNITS:
        head = f"H: x{nl}{nl}"
        text = head + body.replace("\n", nl)
        ends = unit_ends(text, *EN)
        got, a = [], len(head)
        for z in ends:
            chunk = "\n".join(x for x in text[a:z].replace(nl, "\n").split("\n") if not x.startswith(">")).strip()
            got.append(chunk)
            a = z
        assert got == want
    assert paragraphs("no body") == [] and items("2. x\n3. y") == []


def test_learning(spark):
    rng = random.Random(6)
    names, nouns = ["Venn", "Drosk", "Quarne", "Torvek", "Ibrask"], ["pump", "valve", "garden", "window", "ledger"]
    docs = []
    for i in range(120):
        s = [f"The {rng.choice(nouns)} saw Dr. {rng.choice(names)} near the {rng.choice(nouns)}." if rng.random() < 0.6 else f"It cost approx. {rng.randint(1, 99)} of every {rng.choice(nouns)}." for _ in range(6)]
        docs.append((i, "H: x\n\n" + " ".join(s), "EN " if i % 2 else "en", "text/plain", "7bit", len(s)))
    docs += [(900, None, "en", "text/plain", "7bit", 0), (901, "H: x\n\nA. B", "en", "text/html", "7bit", 0), (902, "H: x\n\nA. B", "en", "text/plain", "base64", 0), (903, "", None, "text/plain", "8bit", 0), (904, "H: x\n\nJust one", None, "TEXT/PLAIN", "8BIT", 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, ctype string, cte string, n int").withColumnRenamed("n", "end_pos")
    rows = eligible(df)
    model = learn(rows)
    assert {"dr", "approx"} <= set(model.abbreviations["en"]) and not {"pump", "ledger", "the"} & set(model.abbreviations["en"])
    counted = {r.doc_id: r["count"] for r in sentence_units(rows, model).groupBy("doc_id").count().collect()}
    assert counted == {i: n for i, *_, n in docs if n}
    assert learn(rows.limit(0)) == Model() and sentence_units(rows.limit(0), model).count() == 0
    assert model.of("xx")[0] == model.abbreviations["und"]
    assert words("Ab­c d-e") == ["abc", "d", "e"]


def test_chance_is_not_learned(spark):
    rng = random.Random(8)
    en = ["The pump saw Dr. Venn near the garden.", "We met Rose at noon.", "The rose was red.", "We met Rose and Venn here."]
    de = ["Am 3. Oktober kam die Pumpe.", "Der Oktober war kalt.", "Es war im Oktober.", "Die Pumpe kam."]
    rows = [(i, "H: x\n\n" + " ".join(rng.choice(s) for _ in range(8)), lang) for i in range(100) for lang, s in (("en", en), ("de", de))]
    rows += [(500, "H: x\n\nThe pump saw Dr. Rose near the garden.", "en"), (501, "H: x\n\nAm 3. Pumpe.", "de")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = learn(df)
    assert "dr" in model.abbreviations["en"] and "rose" not in model.starters.get("en", set())  # once after dr., seldom after a break
    assert model.follows["de"] == {"oktober"}  # also where most of its uses stand elsewhere
    ends = {r.doc_id: r["count"] for r in sentence_units(df.where("doc_id >= 500"), model).groupBy("doc_id").count().collect()}
    assert ends[500] == 1
