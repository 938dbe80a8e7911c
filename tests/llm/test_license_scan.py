import random
import re

from cohortspark.llm import license_scan
from cohortspark.llm.license_scan import Automaton, find_licenses
from tests.conftest import SF_ORACLE
from tests.llm.conftest import rows


def words(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def as_regex(template):
    """The template as a pattern over space-joined words, written independently."""
    out, at = "", 0
    for m in [*license_scan.MARK.finditer(template), None]:
        for w in words(template[at:m.start() if m else None]):
            out += re.escape(w) + " "
        if m is None:
            return re.compile(r"(?<= )" + out)
        out += {"o": "(?:", "e": ")?", "v": rf"(?:\S+ ){{0,{m[2]}}}"}[m[1][0]]
        at = m.end()


def test_automata_accept_what_the_templates_say():
    rnd = random.Random(2)
    for label, template in license_scan.TEMPLATES.items():
        automaton, pattern = Automaton(template), as_regex(template)
        plain = words(license_scan.MARK.sub(" ", template))
        bare, last = template, None
        while bare != last:  # optional regions may hold others
            bare, last = re.sub(r"<<optional>>[^<]*(?:<<var \d+>>[^<]*)*<<end>>", " ", bare), bare
        bare = words(bare)
        for base in (plain, bare):
            for _ in range(40):
                text = list(base)
                for _ in range(rnd.randrange(3)):
                    k = rnd.randrange(len(text))
                    text[k:k + 1] = rnd.choice([[], ["foo"], [text[k], "bar"]])
                line = " " + " ".join(text) + " "
                whole = {b for a in [pattern.match(line, 1)] if a for b in [a.end()]}
                end = automaton.match([w.encode() for w in text], 0)
                assert bool(whole) == (end is not None), (label, line)


def test_base_places(spark, checkpoints):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    got = {r.doc_id: r for r in license_scan.license_digest(
        license_scan.scan_licenses(docs)).collect()}
    for r in docs.collect():
        w, places = words(r.text), []
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            places += [(s, label) for s in range(len(w)) if w[s:s + len(p)] == p]
        g = got[r.doc_id]
        starts = [s for s, _ in places]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == (
            len(w), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({k for _, k in places})))
        assert set(g.base_labels.split(",")) <= set(g.labels.split(",")) or not g.base_labels
        assert 0 <= g.score <= 1 and (g.score > 0) == bool(g.labels)
    assert any("cc-notice" in r.labels for r in got.values())


def test_mandatory_words_must_match():
    text = license_scan.MARK.sub(" ", license_scan.TEMPLATES["mit-text"]).encode()
    assert [k for k, _, _ in find_licenses(b"x " + text)[1]] == ["mit-text"]
    assert find_licenses(text.replace(b"hereby", b"thereby"))[1] == []
    n, found = find_licenses(b"MIT License MIT License mit licensed mit-license")
    assert n == 8 and [f for f in found if f[0] == "mit"] == [
        ("mit", 0, 2), ("mit", 2, 4), ("mit", 6, 8)]


def test_texts_are_read_to_the_end_of_their_wording():
    """An opening with other conditions after it is not the license."""
    full = {k: " ".join(license_scan.MARK.sub(" ", t).split())
            for k, t in license_scan.TEMPLATES.items()}
    labels = lambda text: {k for k, _, _ in find_licenses(text.encode())[1]}
    mit = full["mit-text"].replace("SHALL", "SHALL THE AUTHORS OR COPYRIGHT HOLDERS")
    assert labels(f"MIT License Copyright (c) 2020 Jane Doe {mit} Yes.") == {"mit", "mit-text"}
    opening = mit[:mit.index("THE SOFTWARE IS PROVIDED")]
    assert labels(opening + " provided you pay the author a fee") == set()
    assert labels(mit.replace("WITHOUT WARRANTY", "WITH A WARRANTY")) == set()
    two = re.sub(r"<<optional>> <<optional>> 3.*?permission. <<end>>", " ",
                 license_scan.TEMPLATES["bsd-text"], flags=re.S)
    holder = "THE COPYRIGHT HOLDERS AND CONTRIBUTORS"
    two = " ".join(license_scan.MARK.sub(" ", two).split()).replace("PROVIDED BY", f"PROVIDED BY {holder}")
    assert labels(two) == {"bsd-text"}
    assert labels(two[:two.index("THIS SOFTWARE IS PROVIDED")]) == set()
    three = full["bsd-text"].replace("the name of", "the name of the University of California, "
                                     "Berkeley, The Regents, Jane Doe and Company Limited")
    assert labels(three) == {"bsd-text", "bsd-3-clause"}
    apache = full["apache-statement"].replace("License at", "License at "
                                              "http://www.apache.org/licenses/LICENSE-2.0")
    assert labels(apache) == {"apache", "apache-notice", "apache-statement"}
    assert "gpl-statement" in labels(full["gpl-statement"])
    assert labels(full["zlib-text"]) == {"zlib-text"} and labels(full["unlicense"]) == {"unlicense"}


def test_edges(edge_docs, no_docs):
    got = license_scan.license_digest(license_scan.scan_licenses(edge_docs))
    assert sorted(r.n_words for r in got.collect()) == sorted(
        len(words(r.text)) for r in edge_docs.collect())
    assert all(r.score == 0 and r.labels == "" and r.first_word is None for r in got.collect())
    assert rows(license_scan.license_digest(license_scan.scan_licenses(no_docs))) == []
