import random

from tests.llm.helpers import components, docs, odd_columns, shingles
from votecount.llm import substring as s


def brute(rows):
    """rows of (id, text): the text each keeps, first occurrence of every group staying."""
    places = []
    for i, (doc, text) in enumerate(rows):
        for line, t in enumerate((text or "").split("\n")):
            if len(t.split()) >= s.MIN_WORDS:
                places.append((doc is None, doc or 0, line, i, shingles(t)))
    places.sort(key=lambda p: p[:4])

    def linked(i, j):
        a, b = places[i][4], places[j][4]
        return 100 * len(a & b) >= s.PCT * len(a | b)

    roots = components(len(places), linked)
    gone = {(p[3], p[2]) for i, p in enumerate(places) if roots[i] != i}
    return [
        None if text is None else "\n".join(t for n, t in enumerate(text.split("\n")) if (i, n) not in gone)
        for i, (_, text) in enumerate(rows)
    ]


def line(rnd, n):
    return " ".join(f"w{rnd.randint(0, 5000)}" for _ in range(n))


def test_as_brute_force_says(spark):
    rnd = random.Random(11)
    shared = [line(rnd, rnd.choice([30, 55, 80, 200])) for _ in range(6)]

    def variant(t):
        w = t.split()
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 10**6)}"
        return " ".join(w)

    texts = []
    for _ in range(80):
        lines = [line(rnd, rnd.choice([3, 12, 40, 70])) for _ in range(rnd.randint(1, 4))]
        if rnd.random() < 0.6:
            lines.insert(rnd.randint(0, len(lines)), variant(rnd.choice(shared)))
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", shared[0], f"{shared[1]}\n{shared[1].upper()}", "short line\n" * 50, "short line"]
    got = {r.doc_id: r for r in s.report(docs(spark, texts)).collect()}
    for i, wanted in enumerate(brute(list(enumerate(texts)))):
        assert got[i].text == wanted
        assert got[i].n_removed == len(got[i].removed_lines)
        assert (got[i].n_removed > 0) == bool(got[i].kept_in)


def test_repeats_nulls_columns_and_empty_tables(spark):
    rnd = random.Random(12)
    passage, own = line(rnd, 60), line(rnd, 20)
    df = odd_columns(
        docs(spark, [(4, passage), (4, passage), (2, f"{own}\n{passage}"), (None, f"{passage}\nmine"), (None, None)]),
        "d1", "line", "n", "root", "wanted",
    )
    kept = s.drop_repeats(df)
    assert kept.columns == df.columns
    # 2 has the smallest id; both rows of 4 are one occurrence that goes, and with it the last word.
    assert sorted(((r.doc_id or 0), r.text or "") for r in kept.collect()) == [(0, ""), (0, "mine"), (2, f"{own}\n{passage}")]
    assert s.report(df).count() == 5
    assert s.report(df.where("doc_id = 99")).count() == 0


def test_one_very_common_passage(spark):
    rnd = random.Random(13)
    passage = line(rnd, 50)
    texts = [f"{passage}\n{line(rnd, 35)}" for _ in range(300)]
    got = s.report(docs(spark, texts)).collect()
    assert sum(passage in r.text for r in got) == 1
    assert all(r.text.endswith(texts[r.doc_id].split("\n")[1]) for r in got)


def uncovered(texts):
    """Per text the words that no window of 50 words with an equal one before it covers."""
    seen, out = set(), []
    for t in texts:
        w = t.split()
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            window = tuple(w[i : i + 50])
            if window in seen:
                gone[i : i + 50] = [True] * 50
            seen.add(window)
        out.append([x for x, g in zip(w, gone, strict=True) if not g])
    return out


def test_shared_runs_across_and_within_lines(spark):
    """Runs in short lines, inside long lines and twice in one text, as a brute force over windows says."""
    rnd = random.Random(14)
    runs = [line(rnd, n).split() for n in (49, 50, 63, 90, 400)]

    def broken(w):
        """Lines of at most 29 words, which are no paragraphs."""
        ends = [rnd.choice([" ", " ", "\t"]) if i % 25 else rnd.choice(["\n", " \n\n"]) for i in range(len(w))]
        return "\n" + "".join(x + e for x, e in zip(w, ends, strict=True)) + "\n"

    texts = [f"{line(rnd, 200)} {' '.join(runs[3])}"]
    for _ in range(60):
        parts = [line(rnd, rnd.choice([0, 5, 90, 200])) + rnd.choice(["\n", " "]) for _ in range(4)]
        for _ in range(rnd.randint(0, 2)):
            run = rnd.choice(runs)
            cut = rnd.randint(0, len(run) - 49)
            # Inside a line the rest is long enough for the paragraphs to be unlike.
            within = f"{line(rnd, 2 * len(run))} {' '.join(run[cut:])} "
            parts.insert(rnd.randint(0, 4), rnd.choice([broken(run[cut:]), within]))
        texts.append("".join(parts))
    texts.append("\n".join(" ".join(runs[3][i : i + 9]) for i in range(0, 90, 9)) + "\nend \u00e9 \u6f22")
    got = {r.doc_id: r for r in s.report(docs(spark, texts)).collect()}
    wanted = uncovered(texts)
    for i, t in enumerate(texts):
        assert got[i].text.split() == wanted[i]
        assert (got[i].text == t) == (not got[i].removed_lines and not got[i].cut_lines)
        assert set(got[i].kept_in) <= set(range(i + 1))
    assert sum(len(t.split()) > len(w) for t, w in zip(texts, wanted, strict=True)) > 20
    assert got[61].text == "end \u00e9 \u6f22" and got[61].removed_lines == list(range(10))


def test_a_phrase_over_and_over_goes_only_in_later_documents(spark):
    rnd = random.Random(15)
    column, block = "stock line\n" * 60, (line(rnd, 20) + "\n") * 2 + line(rnd, 20) + "\n"
    got = {r.doc_id: r.text for r in s.report(docs(spark, [column, f"own words\n{column}", block + block])).collect()}
    assert got == {0: column, 1: "own words\n", 2: block}
