"""Line deduplication: tokens at any white space, and lines of variable tokens alone."""

from retailforge.llm import common, linededup
from tests.conftest import spark  # noqa: F811,F401


def dedup(spark, bodies):  # noqa: F811
    common.prepare(spark)
    rows = [(i, b) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.row.doc_id: r for r in linededup.deduplicate_lines(df).collect()}


def name(i):
    return "".join(chr(97 + int(d)) for d in str(i + 100))


def test_white_space_runs_do_not_hide_a_template(spark):  # noqa: F811
    spaced = ["all rights of this notice are reserved", "all  rights of this notice are reserved", "\tall rights of\tthis notice are reserved",
              "  all rights of this  notice are reserved ", "all\x0brights\fof this notice are reserved\r"]
    bodies = [f"{name(i)} text of its own goes here {name(i)}\n{spaced[i % 5]}\n \t" for i in range(5)]
    for i, r in dedup(spark, bodies).items():
        assert (r.n_lines, r.n_dropped) == (3, 1) and r.kept_text == "\n".join(bodies[i].split("\n")[::2])


def test_lines_of_variable_tokens_are_compared_literally(spark):  # noqa: F811
    def lines(i):
        return [f"{i},some,{i * 7},csv", f"https://a.example/{name(i)}/{i}", f"第{i}章は{name(i)}について", f"{i}\t{i * 3}\t{i * 5}\t{i * 9}",
                f"{i} {i + 1} {i + 2} {i + 3} {i + 4}"]
    bodies = ["\n".join([f"{name(i)} own words stand here", *lines(i), "7 7 7 7 8"]) for i in range(12)]
    for i, r in dedup(spark, bodies).items():
        assert r.n_dropped == 1 and r.kept_text == bodies[i].rsplit("\n", 1)[0]


def test_copies_count_once_and_do_not_hide_a_passage(spark):  # noqa: F811
    passage = "this passage of quite some words stands in many different documents of the collection"
    bodies = [f"{name(i)} words of its own\n{passage}\nend of {name(i)} comes here now" for i in range(40)]
    bodies += [bodies[0]] * 1000
    for i, r in dedup(spark, bodies).items():
        assert r.n_dropped == 1 and passage not in r.kept_text
    copies = ["a copied document has one line of words\nand a second line of its own words"] * 500
    assert all(r.n_dropped == 0 for r in dedup(spark, copies).values())


def test_shared_boilerplate_around_one_own_line(spark):  # noqa: F811
    top, end = ["aa first line of the site here", "bb second line of the site", "cc third line of this site"], ["yy the last but one line", "zz the very last line of all"]
    bodies = ["\n".join([*top, f"{name(i)} is what this page itself says", *end]) for i in range(200)]
    for i, r in dedup(spark, bodies).items():
        assert r.n_dropped == 5 and r.kept_text == bodies[i].split("\n")[3]


def test_whole_copies_are_left_to_the_document_level(spark):  # noqa: F811
    lines = [f"shared line number {c} of the family stands here" for c in ("one", "two", "three", "four")]
    bodies = [f"{name(i)} opens this text in its way\n" + "\n".join(lines) for i in range(5)] + ["\n".join(lines), "\n".join(lines[::-1])]
    got = dedup(spark, bodies)
    assert all(got[i].n_dropped == 4 for i in range(5)) and all(got[i].n_dropped == 0 for i in (5, 6))


def plain(bodies):
    """Brute force: lines with digits masked, no generalisation inside a leaf."""
    import re
    form = lambda l: (lambda t: t if all(re.search("[0-9]", w) for w in t.split(" ")) else re.sub("[^ ]*[0-9][^ ]*", "<*>", t))(re.sub("[ \t\x0b\f\r]+", " ", l).strip(" "))
    sets = {frozenset(form(l) for l in b.split("\n")) - {""} for b in bodies}
    seen = {}
    for s in sets:
        for l in s:
            seen[l] = seen.get(l, 0) + 1
    recurs = {l for l, n in seen.items() if n >= (10 if len(l.split(" ")) <= 3 else 3)}
    out = []
    for b in bodies:
        own = {form(l) for l in b.split("\n")} - {""}
        out.append(b if own <= recurs else "\n".join(l for l in b.split("\n") if form(l) not in recurs or form(l) == ""))
    return out


def test_against_brute_force(spark):  # noqa: F811
    import random
    rnd = random.Random(4)
    pool = [f"{name(i)} {name(i + 1)} {name(i + 2)} {i % 3} tail" if i % 4 else f"{name(i)} {i}" for i in range(60)]
    bodies = ["\n".join(rnd.sample(pool, rnd.randint(1, 5)) + [f"{name(300 + i)} {name(i)} {name(i + 7)} alone here"] * rnd.randint(0, 1) + [""] * rnd.randint(0, 2))
              for i in range(150)]
    bodies += bodies[:40]
    got = dedup(spark, bodies)
    assert [got[i].kept_text for i in range(len(bodies))] == plain(bodies)
