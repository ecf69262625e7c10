"""What the random field and the pattern graph find beyond the fixed patterns, on planted cases."""

import random
import string

from gristmill.llm import pii, secrets

MIXED = string.ascii_letters + string.digits


def prose(rng, n):
    words = ["".join(rng.choice("abdeghilnorstu") for _ in range(rng.randint(2, 11))) for _ in range(n)]
    return " ".join(w + rng.choice(["", "", "", ",", "."]) for w in words)


def value(rng, n):
    return rng.choice(string.ascii_letters) + rng.choice(string.digits) + "".join(rng.choice(MIXED) for _ in range(n - 2))


def test_field_finds_planted_secrets_and_leaves_prose(spark):
    """Names that no fixed pattern knows before values of the usual shapes; nothing else is added."""
    rng = random.Random(5)
    rows, planted = [], {}
    for i in range(600):
        a, b = prose(rng, rng.randint(20, 60)), prose(rng, rng.randint(20, 60))
        if i % 4 == 0:
            name = rng.choice(["token", "password", "api_key", "secret"])
            a += f" {name} = \"{value(rng, rng.randint(20, 38))}\" "
        elif i % 48 == 1:
            v = value(rng, rng.randint(20, 38))
            a += f" {rng.choice(['credential', 'passphrase', 'signing', 'licence'])} = \""
            planted[i] = (len(a), len(a) + len(v))
            a += f"{v}\" "
        elif i % 4 == 3:
            a += rng.choice([" +1 (843) 555-7672 ", " version 2.0, ", " 12 of 40 ", " total = 14 ", " see https://a.example/b/c ", " \"quoted\" "])
        rows.append((i, a + b))
    rows += [(1000, None), (1001, ""), (1002, " ".join(r[1] for r in rows[:1] * 50))]
    added, hit = 0, set()
    for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        for f in r["found"]:
            if f["kind"] == "crf":
                added += 1
                want = planted.get(r["doc_id"])
                if want and f["begin"] < want[1] and f["end"] > want[0]:
                    hit.add(r["doc_id"])
    assert len(hit) >= 0.9 * len(planted) and len(hit) >= 0.9 * added


def test_lead_adds_nothing_that_held_out_texts_deny():
    field = secrets._untaught(secrets._words([]))
    field.tables[0][:] = 9.0  # all tokens look like secrets
    lx = secrets.lex(secrets.pa.array(["plain words alone", "more of them"]), secrets.SPACED)
    assert secrets._lead(field, [(lx, secrets.np.zeros(6, int))]) == float("inf")
    field.tables[0][:] = 90.0  # and no lead tried is enough
    field.lead = secrets._lead(field, [(lx, secrets.np.zeros(6, int))])
    assert field.lead == float("inf") and not secrets.tag(field, lx).any()


def test_graph_finds_planted_identifiers(spark):
    """Values that no fixed pattern matches, in contexts that seeds have taught; other numbers are left."""
    rng = random.Random(8)
    number = lambda n: "".join(rng.choice(string.digits) for _ in range(n))
    seeds = {
        "reach me at {} today": lambda: f"+1 ({number(3)}) 555-{number(4)}",
        "my mail is {} thanks": lambda: f"u{number(4)}@mail.example.com",
        "from host {} port": lambda: f"10.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}",
    }
    unseen = {
        "reach me at {} today": lambda: f"({number(3)}) 555-{number(4)}",
        "my mail is {} thanks": lambda: f"u{number(4)}@intranet",
        "from host {} port": lambda: f"10.{rng.randint(300, 999)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}",
    }
    others = ["version {} of it", "since {} they", "page {} says"]
    rows, planted = [], {}
    for i in range(360):
        a, b = prose(rng, rng.randint(3, 30)), prose(rng, rng.randint(3, 30))
        t = list(seeds)[i % 3]
        if i % 12 < 9:
            rows.append((i, f"{a} {t.format(seeds[t]())} {b}"))
        elif i % 72 < 12:
            v = unseen[t]()
            line = f"{a} {t.format(v)} {b}"
            planted[i] = (line.index(v), line.index(v) + len(v))
            rows.append((i, line))
        else:
            rows.append((i, f"{a} {rng.choice(others).format(number(rng.randint(1, 6)))} {b}"))
    found = set()
    for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found |= {(r["doc_id"], f["begin"], f["end"]) for f in r["found"] if f["kind"] == "found"}
    want = {(i, *span) for i, span in planted.items()}
    assert len(found & want) >= 0.9 * len(want) and len(found & want) >= 0.9 * len(found)


def test_numbers_in_groups_are_one_value():
    texts = ["x +1 (555) 000-1111 2222 y", "n 12 34, 56", None, "", "_ 7\n8", "u@x (826) 555-1 .9."]
    _, context = pii._contexts(pii.pa.array(texts))
    assert [(d, kind, value) for d, kind, value, *_ in context] == [
        (0, "phone", "+1 (555) 000-1111 2222"), (1, "", "12 34"), (1, "", "56"), (4, "", "7"), (4, "", "8"), (5, "", "u@x"), (5, "", "(826) 555-1 .9")
    ]
