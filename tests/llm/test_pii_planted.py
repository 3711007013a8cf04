"""Recall of the added kinds on planted strings of shapes listed by hand, and look-alikes that must stay."""

import random

from quillgraph.llm import pii

#: "#" is a digit, "?" a lower-case letter: shapes of several countries and the words before them.
SHAPES = {
    "national_phone": (
        ["030 #######", "0171 #######", "(089) ######", "06 ## ## ## ##", "01 ## ## ## ##", "020 #### ####", "07### ######", "6## ### ###", "(2##) 555-01##", "1-8##-555-####", "2##.555.####", "55########", "040/######"],
        ["Tel: {}.", "phone {} today", "please call me at {}, thanks", "Fax: {}\n", "Telefon: {} (Büro)", "Handy {} abends"],
    ),
    "masked_email": (
        ["????_at_?????_dot_com", "????.??? -at- ????? -dot- org", "???? @ ????? . net", "????(at)?????.de", "???? [at] ????? [dot] fr", "????-at-?????.com", "???##@ ?????.com".replace("@ ", " @ ")],
        ["contact: {} please", "mail me at {} ", "write to {}, or not", "I am {} now"],
    ),
    "secret": (["???????##", "????##!????", "##??##??##??##??", "AKIAQ?Q?Q?Q?Q?Q?Q?Q?".upper().replace("?", "7")], ["passwort: {}\n", "Kennwort: {} ", "password={} ", 'token: "{}"', "api_key = '{}'"]),
    "national_id": (["1## 45 ####", "2##-55-####", "AB ## ## ## C", "CE######D", "2 ## 0# ## ### ### ##", "########Z", "Y-#######-H", "## ### ### ###"], ["SSN: {} ", "NINO: {},", "DNI: {} ", "Steuer-ID: {} ", "identity card {} ", "national insurance number {} "]),
}
ALIKE = [
    "on 2024-01-02, 01.02.2024 and 12/31/1999", "order 123 456 7890 of 1 000 000 items", "look-at-me.now and a_at_b.py", "pages 123-456 and 1234-5678", "lot 20240102 of 00123-456", "gb29 words that are text here", "ab12 cdef ghij klmn opqr",
    "see AB 12 34 56 C in the list", "at 10.30 or at 5 . 30", "row 12345678 of 87654321", "he was @ home . Nobody knew",
]


def test_planted_strings(spark):
    rng = random.Random(77)
    rows = []
    for kind, (shapes, texts) in SHAPES.items():
        for k in range(72):
            data = "".join(rng.choice("0123456789") if c == "#" else rng.choice("abcdefghijklmnoprstuvw") if c == "?" else c for c in shapes[k % len(shapes)])
            text = f"Wir {rng.choice(['sind', 'are', 'sont'])} here. " + texts[(k // len(shapes)) % len(texts)].format(data)
            rows.append((kind, text, data))
    docs = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(rows)] + [(10_000 + i, t) for i, t in enumerate(ALIKE)], "doc_id long, text string")
    found = {r.doc_id: r.spans.split(",") for r in pii.detect(docs).collect()}
    missed = {}
    for i, (kind, text, data) in enumerate(rows):
        if f"{kind}:{text.index(data)}:{text.index(data) + len(data)}" not in found[i]:
            missed.setdefault(kind, []).append((text, found[i]))
    assert len(rows) >= 200 and all(len(v) <= 7 for v in missed.values()), {k: (len(v), v[:12]) for k, v in missed.items()}
    assert {ALIKE[i - 10_000]: s for i, s in found.items() if i >= 10_000 and s != [""]} == {}
