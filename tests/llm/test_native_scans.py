import math
import re
from collections import Counter

from loamline.llm import license_scan, quality_rules

from tests.llm.cases import TRICKY, frame

SPACES = " \t\n\x0b\x0c\r"


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def _repeat(w):
    n = Counter(zip(w, w[1:], w[2:], strict=False))
    return len({i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)})


def test_quality_metrics_equal_plain_python(spark):
    texts = TRICKY + ["the and of " * 40, "a b c d a b c e a b c " * 9, "good words in the text and more " + "filler%d " * 3, "\n".join(["- item the"] * 30)]
    df = frame(spark, texts).selectExpr("*", "'x' as metrics", "1 as kept", "2 as words")
    out = {r.doc_id: r for r in quality_rules.apply_rules(df).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        w, m, t = _words(t), out[i].metrics, t or ""
        lines = [x for x in t.split("\n") if x.strip(SPACES)]
        assert (m.n_words, m.word_chars, m.n_symbols) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>")), repr(t)
        assert (m.n_dup_lines, m.n_repeat_words) == (len(lines) - len(set(lines)), _repeat(w)), repr(t)
        assert out[i].base_failed == (len(w) < 50 or 100 * _repeat(w) > 50 * len(w))
        assert out[i].words == 2 and not (out[i].base_failed and out[i].kept)


def test_native_scans_of_an_empty_table(spark):
    assert quality_rules.apply_rules(frame(spark, [])).count() == 0
    assert license_scan.scan(frame(spark, [])).count() == 0


def test_licence_places_equal_plain_python(spark):
    texts = TRICKY + [
        "CC BY-NC 4.0 and cc-by, also Licensed under CC BY 4.0",
        "All Rights Reserved all rights\nreserved. ALL rights reservedx all RIGHTS  reserved",
        "This work is licensed under the GNU General Public License, version 3. cc Kind by",
        "general public licenseé General Public LICENSE",
        "all rights all rights reserved cc cc by by",
        "See the MIT license. Released under the MIT License; Mozilla Public License Version 2.0 or Mozilla Public License",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
        "products used to endorse or promote products, GNU Lesser General Public License, version 2.1",
        "filler " * 200_000 + "all rights reserved " + "by cc " * 2000 + "redistributions of source code must retain",
    ] + [f"{t.text} {k}" for k, t in enumerate(license_scan.TEMPLATES)] + [t.key for t in license_scan.TEMPLATES]
    df = frame(spark, texts).selectExpr("*", "'x' as licence", "5 as spans", "6 as words")
    out = {r.doc_id: r for r in license_scan.scan(df).collect()}
    upper = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    cut = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(upper)) for t in texts]
    idf = {x: math.log((len(texts) + 1) / (sum(x in w for w in map(set, cut)) + 1)) + 1 for x in license_scan.VOCABULARY}
    dropped = 0
    for i, w in enumerate(cut):
        want, best = [], 0.0
        for x in license_scan.TEMPLATES:
            key = x.key.split()
            for k in (k for k in range(len(w)) if w[k : k + len(key)] == key):
                there = [y for j, y in enumerate(x.words) if 0 <= k + j - x.key_at < len(w) and w[k + j - x.key_at] == y]
                share = sum(map(idf.get, there)) / sum(map(idf.get, x.words))
                if x.base or round(share, 9) >= license_scan.LEAST_SHARE:
                    want.append((x.label, k))
                    best = max(best, share)
                else:
                    dropped += 1
        assert out[i].licence.n_words == len(w)
        assert sorted((s.label, s.start) for s in out[i].licence.spans) == sorted(want), repr(texts[i])[:200]
        assert abs(out[i].licence.score - best) < 1e-9
    assert dropped > 3 and round(out[len(TRICKY) + 2].licence.score, 9) == 1.0


def test_licence_words_are_looked_up_rarest_first():
    idf = dict.fromkeys(license_scan.VOCABULARY, 1.0) | {"public": 3.0, "license": 2.0}
    first, second = license_scan.rare_index(idf)
    gpl = next(n for n, t in enumerate(license_scan.TEMPLATES) if t.key == "general public license")
    assert (gpl, 1) in first["public"] and (gpl, 2) in second["license"] and len(license_scan.TEMPLATES) < 256
    assert sum(map(len, first.values())) == sum(map(len, second.values())) == len(license_scan.TEMPLATES)
