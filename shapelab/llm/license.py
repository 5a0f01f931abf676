"""License scan by ordered signature rules.

A text is reduced to its words (A-Z lower-cased; runs of digits, letters and all
characters beyond ASCII) joined by one space.  Hundreds of regular expressions,
three forms for each signature below, are tried on that line, each only if a literal
that its every match holds occurs in it at all.  Overlapping detections are resolved in order of
priority, then of length, then of place: one that lies within an interval already
taken by an equal or higher priority is suppressed, so `gnu lesser general public
license version 3` yields one label and not four.

Base phrases are counted apart and their labels always stay.

Defined results: a null text is empty; an empty text has no words, no labels, and
score 0; equal detections count once.
Texts of any length are read whole; repeated rows get equal results and an empty table
gives an empty one; only the key and text are read, so other columns may have any names.
"""

from __future__ import annotations

import re
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, lean, row_slices

# Phrases and labels of the contract.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Signatures: label | keyword | name as it is written out | short identifier.
# V stands for an optional word before a version number.
SIGNATURES = """
gpl-1.0|general|gnu general public license V1(?: 0)?|gpl 1 0(?: only| or later)?
gpl-2.0|general|gnu general public license V2(?: 0)?|gpl 2 0(?: only| or later)?
gpl-3.0|general|gnu general public license V3(?: 0)?|gpl 3 0(?: only| or later)?
gpl-2.0-v|gplv2|gnu gplv2|gplv2(?: only| or later)?
gpl-3.0-v|gplv3|gnu gplv3|gplv3(?: only| or later)?
gpl|general|(?:gnu )?general public licen[cs]e|gnu gpl
lgpl-2.0|library|gnu library general public license V2(?: 0)?|lgpl 2 0(?: only| or later)?
lgpl-2.1|lesser|gnu lesser general public license V2 1|lgpl 2 1(?: only| or later)?
lgpl-3.0|lesser|gnu lesser general public license V3(?: 0)?|lgpl 3 0(?: only| or later)?
lgpl|lesser|gnu lesser general public licen[cs]e|gnu lgpl
agpl-1.0|affero|affero general public license V1(?: 0)?|agpl 1 0(?: only| or later)?
agpl-3.0|affero|gnu affero general public license V3(?: 0)?|agpl 3 0(?: only| or later)?
agpl|affero|gnu affero general public licen[cs]e|gnu agpl
gfdl-1.1|documentation|gnu free documentation license V1 1|gfdl 1 1(?: only| or later)?
gfdl-1.2|documentation|gnu free documentation license V1 2|gfdl 1 2(?: only| or later)?
gfdl-1.3|documentation|gnu free documentation license V1 3|gfdl 1 3(?: only| or later)?
gfdl|documentation|gnu free documentation licen[cs]e|gnu fdl
apache-1.0|apache|apache (?:software )?license V1 0|apache 1 0
apache-1.1|apache|apache (?:software )?license V1 1|apache 1 1
apache-2.0|apache|apache (?:software )?license V2(?: 0)?|apache 2 0
apache|apache|apache (?:software )?licen[cs]e|asl 2 0
mit|mit|(?:the )?mit licen[cs]e|mit
mit-0|attribution|mit no attribution(?: license)?|mit 0
mit-x11|x11|(?:mit )?x11 licen[cs]e|x11
mit-expat|expat|expat licen[cs]e|expat
isc|isc|(?:the )?isc licen[cs]e|isc
bsd-1-clause|bsd|(?:bsd 1 clause|1 clause bsd) license|bsd 1 clause
bsd-2-clause|bsd|(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd) license|bsd 2 clause
bsd-3-clause|bsd|(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd) license|bsd 3 clause
bsd-4-clause|bsd|(?:bsd 4 clause|4 clause bsd|original bsd) license|bsd 4 clause
bsd-0|bsd|(?:zero clause bsd|bsd zero clause|0 clause bsd) license|0bsd
bsd|bsd|bsd(?: style)? licen[cs]e|bsd licensed
mpl-1.0|mozilla|mozilla public license V1 0|mpl 1 0
mpl-1.1|mozilla|mozilla public license V1 1|mpl 1 1
mpl-2.0|mozilla|mozilla public license V2(?: 0)?|mpl 2 0
mpl|mozilla|mozilla public licen[cs]e|mozilla mpl
epl-1.0|eclipse|eclipse public license V1(?: 0)?|epl 1 0
epl-2.0|eclipse|eclipse public license V2(?: 0)?|epl 2 0
edl-1.0|eclipse|eclipse distribution license V1(?: 0)?|edl 1 0
cpl-1.0|common|common public license V1(?: 0)?|cpl 1 0
ipl-1.0|ibm|ibm public license V1(?: 0)?|ipl 1 0
cddl-1.0|cddl|common development and distribution license (?:cddl )?V1(?: 0)?|cddl 1 0
cddl-1.1|cddl|common development and distribution license (?:cddl )?V1 1|cddl 1 1
cpal-1.0|attribution|common public attribution license V1(?: 0)?|cpal 1 0
eupl-1.1|european|european union public licen[cs]e V1 1|eupl 1 1
eupl-1.2|european|european union public licen[cs]e V1 2|eupl 1 2
artistic-1.0|artistic|artistic license V1(?: 0)?|artistic 1 0
artistic-2.0|artistic|artistic license V2(?: 0)?|artistic 2 0
artistic|artistic|(?:the )?artistic licen[cs]e|perl artistic
zlib|zlib|zlib(?: libpng)? licen[cs]e|zlib
libpng|libpng|(?:libpng|png reference library) licen[cs]e|libpng 2 0
bsl-1.0|boost|boost software license V1(?: 0)?|bsl 1 0
busl-1.1|business|business source license V1 1|busl 1 1
sspl-1.0|server|server side public license V1(?: 0)?|sspl 1 0
elastic-2.0|elastic|elastic license V2(?: 0)?|elastic 2 0
commons-clause|commons|commons clause license condition V1 0|commons clause
polyform-nc|polyform|polyform noncommercial license V1 0 0|polyform noncommercial 1 0 0
polyform-sb|polyform|polyform small business license V1 0 0|polyform small business 1 0 0
unlicense|unlicen|(?:the )?unlicen[cs]e|unlicense
wtfpl|wtf|do what the (?:fuck|f) you want to public license|wtfpl
cc0-1.0|cc0|(?:creative commons )?cc0 V1 0(?: universal)?|cc0 1 0
cc0|zero|creative commons zero|cc0
cc-by-1.0|creative|creative commons attribution V1 0|cc by 1 0
cc-by-2.0|creative|creative commons attribution V2 0|cc by 2 0
cc-by-2.5|creative|creative commons attribution V2 5|cc by 2 5
cc-by-3.0|creative|creative commons attribution V3 0|cc by 3 0
cc-by-4.0|creative|creative commons attribution V4 0|cc by 4 0
cc-by-sa-2.0|creative|creative commons attribution share ?alike V2 0|cc by sa 2 0
cc-by-sa-3.0|creative|creative commons attribution share ?alike V3 0|cc by sa 3 0
cc-by-sa-4.0|creative|creative commons attribution share ?alike V4 0|cc by sa 4 0
cc-by-sa|creative|creative commons attribution share ?alike|cc by sa
cc-by-nd-3.0|creative|creative commons attribution no ?deriv(?:ative)?s V3 0|cc by nd 3 0
cc-by-nd-4.0|creative|creative commons attribution no ?deriv(?:ative)?s V4 0|cc by nd 4 0
cc-by-nd|creative|creative commons attribution no ?deriv(?:ative)?s|cc by nd
cc-by-nc-3.0|creative|creative commons attribution non ?commercial V3 0|cc by nc 3 0
cc-by-nc-4.0|creative|creative commons attribution non ?commercial V4 0|cc by nc 4 0
cc-by-nc|creative|creative commons attribution non ?commercial|cc by nc
cc-by-nc-sa-3.0|creative|creative commons attribution non ?commercial share ?alike V3 0|cc by nc sa 3 0
cc-by-nc-sa-4.0|creative|creative commons attribution non ?commercial share ?alike V4 0|cc by nc sa 4 0
cc-by-nc-sa|creative|creative commons attribution non ?commercial share ?alike|cc by nc sa
cc-by-nc-nd-4.0|creative|creative commons attribution non ?commercial no ?deriv(?:ative)?s V4 0|cc by nc nd 4 0
cc-by-nc-nd|creative|creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd
cc|creative|creative commons(?: attribution)? licen[cs]e|creative commons
odbl-1.0|database|open (?:data commons open )?database license V1 0|odbl 1 0
odc-by-1.0|commons|open data commons attribution license V1 0|odc by 1 0
pddl-1.0|public|(?:open data commons )?public domain dedication(?: and license)? V1 0|pddl 1 0
ogl-3.0|government|open government licen[cs]e V3 0|ogl uk 3 0
ogl|government|open government licen[cs]e|ogl
public-domain|public|(?:released|placed|dedicated) (?:in|into|to) the public domain|public domain
python-2.0|python|python software foundation license V2|psf 2 0
psf|python|python software foundation licen[cs]e|psf license
php-3.01|php|php license V3 01|php 3 01
ruby|ruby|ruby licen[cs]e|ruby license
perl|perl|same terms as perl(?: itself)?|perl 5 terms
openssl|openssl|openssl licen[cs]e|openssl
postgresql|postgresql|postgresql licen[cs]e|postgresql
ofl-1.0|sil|sil open font license V1 0|ofl 1 0
ofl-1.1|sil|sil open font license V1 1|ofl 1 1
ncsa|ncsa|(?:university of illinois )?ncsa open source license|ncsa
ms-pl|microsoft|microsoft public license|ms pl
ms-rl|microsoft|microsoft reciprocal license|ms rl
osl-3.0|open|open software license V3 0|osl 3 0
afl-3.0|academic|academic free license V3 0|afl 3 0
cecill-2.1|cecill|cecill free software license(?: agreement)? V2 1|cecill 2 1
cecill|cecill|cecill(?: free software)? licen[cs]e|cecill
w3c|w3c|w3c software (?:notice and )?license|w3c
upl-1.0|universal|universal permissive license V1 0|upl 1 0
vim|vim|vim licen[cs]e|vim license
tcl|tcl|tcl tk licen[cs]e|tcl
curl|curl|curl licen[cs]e|curl license
icu|icu|icu licen[cs]e|icu
unicode|unicode|unicode (?:data files and software )?licen[cs]e|unicode dfs 2016
ijg|jpeg|independent jpeg group license|ijg
imagemagick|imagemagick|imagemagick licen[cs]e|imagemagick
json|json|json licen[cs]e|json license
beerware|beerware|beerware licen[cs]e|beerware
qpl-1.0|public|q public license V1 0|qpl 1 0
sleepycat|sleepycat|sleepycat licen[cs]e|sleepycat
zpl-2.1|zope|zope public license V2 1|zpl 2 1
openrail|openrail|openrail(?: m)? licen[cs]e|openrail
llama|llama|llama (?:2|3) community license(?: agreement)?|llama2
"""

_VERSION = r"(?:v|v |ver |version )?"


def needed(tree) -> tuple[str, ...]:
    """Literals of which every match of a parsed expression holds one, () if there are none."""
    best, run = (), ""
    for op, arg in [*tree, (None, None)]:
        if op is _parser.LITERAL:
            run += chr(arg)
            continue
        found, run = [(run,) if run else ()], ""
        if op is _parser.SUBPATTERN:
            found.append(needed(arg[-1]))
        elif op is _parser.BRANCH:
            ways = [needed(way) for way in arg[1]]
            found.append(tuple(x for way in ways for x in way) if all(ways) else ())
        best = max([best, *found], key=lambda f: min(map(len, f), default=0))
    return best


def rules() -> list[tuple[str, int, tuple[bytes, ...], re.Pattern]]:
    """(label, priority, gates, expression), in order of priority: a tagged identifier,
    a grant that names the licence, the name with a version, the bare name."""
    out = []
    for line in SIGNATURES.strip().splitlines():
        label, _, name, short = _fields(line)
        name = name.replace("V", _VERSION)
        versioned = any(c.isdigit() for c in label)
        forms = [
            (90, rf"spdx license identifier {short}"),
            (80 if versioned else 70, rf"(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?{name}"),
            (60 if versioned else 50, name),
        ]
        if versioned and " " in short:
            forms.append((40, short))
        out += [(label, p, tuple(k.encode() for k in needed(_parser.parse(x))) or (b"",), re.compile(rf"(?<= )(?:{x})(?= )".encode())) for p, x in forms]
    return sorted(out, key=lambda r: (-r[1], r[0]))


def _fields(line: str) -> tuple[str, str, str, str]:
    """Splits at the bars that stand outside brackets."""
    parts, depth = [""], 0
    for c in line:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return tuple(parts)


# Every byte that no word holds becomes a space; A-Z are lower-cased.
_CLEAN = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def line_of(text: bytes) -> tuple[bytes, int]:
    """The words with one space around each, and their number."""
    words = text.translate(_CLEAN).split()
    return b" " + b" ".join(words) + b" " if words else b" ", len(words)


def resolved(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Detections (priority, start, end, label) that no stronger one contains."""
    kept: list[tuple[int, int, int, str]] = []
    for p, a, b, label in sorted(set(found), key=lambda d: (-d[0], d[1] - d[2], d[1], d[3])):
        if not any(x <= a and b <= y for _, x, y, _ in kept):
            kept.append((p, a, b, label))
    return kept


class Scanner:
    def __init__(self):
        self.gates: dict[tuple[bytes, ...], list] = {}
        for label, priority, gates, expression in rules():
            self.gates.setdefault(gates, []).append((label, priority, expression))
        self.base = [(f" {phrase} ".encode(), len(phrase.split()), label) for phrase, label in BASE.items()]

    def scan(self, text: bytes):
        """(n_words, n_base, first_word, last_word, base labels, detections)."""
        line, n_words = line_of(text)
        places, base_labels = [], set()
        for phrase, _, label in self.base:
            at = line.find(phrase)
            while at >= 0:
                places.append(at)
                base_labels.add(label)
                at = line.find(phrase, at + 1)
        found = []
        for gates, gated in self.gates.items():
            if any(g in line for g in gates):
                for label, priority, expression in gated:
                    found += [(priority, m.start(), m.end(), label) for m in expression.finditer(line)]
        words = [line.count(b" ", 0, p) for p in ((min(places), max(places)) if places else ())]
        return n_words, len(places), words, base_labels, _resolved_fast(found)


def _resolved_fast(found):
    """resolved(), by sweeping groups of overlapping detections one after the other."""
    out, group, reach = [], [], -1
    for d in sorted(set(found), key=lambda d: d[1]):
        if d[1] >= reach and group:
            out += resolved(group)
            group = []
        group.append(d)
        reach = max(reach, d[2])
    return out + resolved(group)


def scan(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections."""
    bound_batches(docs.sparkSession)

    def run(batches):
        scanner = Scanner()
        for batch in row_slices(batches, 8 << 20):
            out = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections")}
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                n, base, ends, base_labels, kept = scanner.scan(text or b"")
                out["n_words"].append(n)
                out["n_base"].append(base)
                out["first_word"].append(ends[0] if ends else None)
                out["last_word"].append(ends[1] if ends else None)
                out["base_labels"].append(",".join(sorted(base_labels)))
                out["labels"].append(",".join(sorted(base_labels | {d[3] for d in kept})))
                out["score"].append(max([d[0] / 100 for d in kept] + [0.5 if base else 0.0]))
                out["n_detections"].append(len(kept))
            types = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
            yield pa.RecordBatch.from_arrays([batch.column(key), *[pa.array(v, types.get(c, pa.int64())) for c, v in out.items()]], names=[key, *out])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, "text").mapInArrow(lean(run), f"`{key}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long")
