import math
import re
import textwrap
from collections import Counter

from tidestream.llm import common, licences

SCHEMA = "doc_id long, path string, text string, licence string, term int"
GPL, MIT, APACHE = "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
BODY = " ".join(f"word{i}" for i in range(50))
ROWS = [
    (1, "/r/LICENSE", GPL),
    (2, "/r/a/x.c", BODY),
    (3, "/r/a/y.c", BODY + "\n" + MIT),
    (4, "/r/a/b/copying.txt", APACHE + "\n" + BODY),
    (5, "/r/a/b/c/z.c", BODY),
    (6, "/q/n.c", BODY),
    (7, "/q/m.c", None),
    (8, None, MIT + " " + BODY),
    (9, None, BODY),
    (10, "/q/w.c", "A license to fish is sold here by old men. " + BODY),
    (11, "/s/only.txt", MIT),
    (12, "/s/t/u", ""),
    (13, "/s/long", (BODY + "\n") * 3000 + APACHE),
    (2, "/r/a/x.c", BODY),
    (14, "/t/x.py", "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND Zlib\n" + BODY),
    (15, "/t/y.py", "/* SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 */\n" + BODY),
]


def tokens(x):
    return [t for t in re.split(r"[^a-z0-9.]+|\.(?![0-9])", x.lower()) if t]


SPACE = "[ \\t\\n\\x0b\\f\\r]+"


def tags(line):
    """A tag for each licence of an SPDX expression."""
    _, tag, expression = re.sub("(?i)spdx-license-identifier:", "\0", line, count=1).partition("\0")
    words = iter(re.sub("[()]", " | ", expression).split()) if tag else ()
    named = [""]
    for w in words:
        if w.lower() in ("or", "and", "|"):
            named.append("")
        elif w.lower() == "with":
            next(words, None)
            named.append("")
        else:
            named[-1] = f"{named[-1]} {w}".strip()
    return [f"SPDX-License-Identifier: {x}" for x in named if re.search("[A-Za-z0-9]", x)]


def units(path, text):
    """(single, passage) of a text."""
    singles = [x.strip(common.SPACES) for x in re.split(licences.SENTENCE, text) if re.search(licences.MENTION, x)]
    singles = [y for x in singles for y in tags(x) or [x]]
    bare = re.sub(licences.END, "", re.sub(licences.BEGIN, r"\1", text))
    larger = [x for x in re.split(licences.BLANK, bare) if re.search(licences.MENTION, x) and re.search(licences.MORE, x, re.ASCII)]
    if path and re.search(licences.NAMED, path):
        larger.append(bare)
    return [(True, x) for x in singles] + [(False, re.sub(SPACE, " ", x).strip(" ")) for x in larger]


def brute(rows):
    found = [(d, p, *u) for d, p, t in rows if t and re.search(licences.MENTION, t) for u in units(p, t)]
    templates = licences.all_templates()
    df = Counter(t for x in [f[3] for f in found] + [t for _, t, _ in templates] for t in set(tokens(x)))
    n = len(found) + len(templates)

    def vector(x):
        v = {t: c * (math.log((1 + n) / (df[t] + 1)) + 1) for t, c in Counter(tokens(x)).items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / norm for t, w in v.items()}

    made = [(name, vector(y), least) for name, y, least in templates]
    own, single, larger = {}, Counter(), Counter()
    for d, p, one, x in found:
        v = vector(x)
        hits = [(-s, name) for name, y, least in made if (s := round(sum(v.get(t, 0) * w for t, w in y.items()), 9)) >= least]
        (single if one else larger)[d, p] += len(x.split()) if one or hits else 0
        if hits:
            own[d, p] = min(own.get((d, p), (0, "")), min(hits))
    words = {k: max(single[k], larger[k]) for k in own}
    given = {}
    for (d, p), (s, name) in own.items():
        text = next(t for a, b, t in rows if (a, b) == (d, p))
        if p and (re.search(licences.NAMED, p) or words[d, p] >= licences.LICENCE_SHARE * len(text.split())):
            given.setdefault(p.rpartition("/")[0], []).append((s, p, d, name))
    out = []
    for d, p, _ in rows:
        mine = own.get((d, p))
        at, got, where = p and p.rpartition("/")[0], mine and mine[1], None
        while not mine and at is not None and got is None:
            if at in given:
                got, where = min(given[at])[3], at
            at = at.rpartition("/")[0] if "/" in at else None
        out.append((d, p, mine and mine[1], got, where))
    return sorted(out, key=str)


def test_matches_brute_force(spark, monkeypatch):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], SCHEMA).repartition(3)
    for most in (20_000, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        got = sorted(((r.doc_id, r.path, r.own_licence, r.licence, r.source_path) for r in licences.licences(df).collect()), key=str)
        assert got == brute(ROWS)
    by = {r[0]: r[3] for r in got}
    assert (by[1], by[2], by[3], by[4], by[5], by[6], by[10], by[12], by[13]) == ("GPL-3.0", "GPL-3.0", "MIT", "Apache-2.0", "Apache-2.0", None, None, "MIT", "Apache-2.0")


def test_empty_table(spark):
    assert licences.licences(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_template_is_compared():
    assert all(re.search(licences.MENTION, t) for _, t, _ in licences.all_templates())


def test_standard_notices_are_found_as_headers(spark):
    """Each notice, wrapped and behind comment marks, in a file of other words; and lines that only sound like licences."""
    rows, want = [], {}
    for k, (name, text, _) in enumerate(licences.all_templates()):
        for style, (first, mark, last) in enumerate([("/*\n", " * ", "\n */"), ("", "# ", ""), ("", "// ", ""), ("", "", "")]):
            lines = textwrap.wrap(text, 72)
            d = 10 * k + style
            rows.append((d, f"/{d}/a.c", first + "\n".join(mark + x for x in lines) + last + "\n\n" + BODY))
            want[d] = name
    noise = ["A license to fish is sold here by old men.", "The library is free to all readers of the town.", "She gave her permission to use the garden.", "SPDX-License-Identifier: LicenseRef-Acme-7", "Drive only with a valid driving licence, version B.", "Their songs fell into the public domain long ago.", "He was licensed as a doctor in 1999.", "Free software meetups are held on Mondays."]
    rows += [(100_000 + k, f"/n{k}/b.c", x + "\n" + BODY) for k, x in enumerate(noise)]
    got = {r.doc_id: r.own_licence for r in licences.licences(spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(4)).collect()}
    right = [got[d] == name for d, name in want.items()]
    assert sum(right) / len(right) >= 0.97, [(d, want[d], got[d]) for d in want if got[d] != want[d]]
    assert not [x for k, x in enumerate(noise) if got[100_000 + k]]


def test_equal_files_take_the_best_of_theirs(spark):
    rows = [(1, "/a/x", BODY), (1, "/a/x", BODY + "\n" + MIT), (1, "/a/x", BODY), (2, "/a/y", BODY)]
    got = [(r.doc_id, r.own_licence, r.licence) for r in licences.licences(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()]
    assert sorted(got, key=str) == [(1, "MIT", "MIT")] * 3 + [(2, None, None)]


def test_spdx_expressions(spark):
    cases = {
        "// SPDX-License-Identifier: (MIT OR Apache-2.0)": "Apache-2.0 MIT",
        "/* SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 */": "GPL-2.0",
        "# spdx-license-identifier: MIT and (ISC or Zlib)": "ISC MIT Zlib",
        "SPDX-License-Identifier: LicenseRef-Acme OR MPL-2.0": "MPL-2.0",
        "SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1",
        "SPDX-License-Identifier: (LicenseRef-A AND LicenseRef-B)": None,
        "SPDX-License-Identifier:": None,
    }
    rows = [(k, f"/{k}/x", f"{line}\n{BODY}") for k, line in enumerate(cases)]
    got = {r.doc_id: (r.own_licences, r.own_licence) for r in licences.licences(spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(3)).collect()}
    assert [got[k][0] for k in range(len(cases))] == list(cases.values())
    assert all(own == (names and names.split(" ")[0]) for names, own in got.values())
