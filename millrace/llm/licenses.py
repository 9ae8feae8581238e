"""License scans by ordered signature rules, with DataFrame expressions only.

A text becomes its lower-case words, one space before each. Rules are regular expressions over
that, built from the table of licenses below: an SPDX tag (priority 1), a grant such as "licensed
under the ..." (2), the bare name (3). A rule is tried only if its keyword occurs; a text without
any keyword tries none. Of overlapping detections one that lies within another of the same or a
higher priority is suppressed. Everything is computed within the row: nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import only

# Phrases and labels of the base.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Label; SPDX identifier in words; keyword; names, as regular expressions over words.
VERSION = r"(?: version| v)?"
LICENSES = (
    ("mit", "mit", "licen", ["(?:the )?mit(?: x11)? license", "(?:the )?expat license", "license mit"]),
    ("mit-0", "mit 0", "licen", ["mit no attribution(?: license)?", "mit 0 license"]),
    ("x11", "x11", "licen", ["(?:mit )?x11 license"]),
    ("apache-1.0", "apache 1 0", "licen", [rf"apache(?: software)? license{VERSION} 1 0"]),
    ("apache-1.1", "apache 1 1", "licen", [rf"apache(?: software)? license{VERSION} 1 1"]),
    ("apache-2.0", "apache 2 0", "licen", [rf"apache(?: software)? license{VERSION} 2(?: 0)?", "apache 2(?: 0)? licensed?", "license apache 2(?: 0)?"]),
    ("gpl-1.0", "gpl 1 0(?: only| or later)?", "gpl", ["(?:gnu )?gpl ?v?1(?: 0)?"]),
    ("gpl-2.0", "gpl 2 0(?: only| or later)?", "gpl", ["(?:gnu )?gpl(?: version)? ?v?2(?: 0)?"]),
    ("gpl-3.0", "gpl 3 0(?: only| or later)?", "gpl", ["(?:gnu )?gpl(?: version)? ?v?3(?: 0)?"]),
    ("gpl-1.0", "gnu gpl 1", "general public licen", [rf"(?:gnu )?general public license{VERSION} 1(?: 0)?"]),
    ("gpl-2.0", "gnu gpl 2", "general public licen", [rf"(?:gnu )?general public license{VERSION} 2(?: 0)?"]),
    ("gpl-3.0", "gnu gpl 3", "general public licen", [rf"(?:gnu )?general public license{VERSION} 3(?: 0)?"]),
    ("gpl", "gpl", "general public licen", ["(?:gnu )?general public license"]),
    ("lgpl-2.0", "lgpl 2 0(?: only| or later)?", "lgpl", ["(?:gnu )?lgpl ?v?2(?: 0)?"]),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?", "lgpl", ["(?:gnu )?lgpl ?v?2 1"]),
    ("lgpl-3.0", "lgpl 3 0(?: only| or later)?", "lgpl", ["(?:gnu )?lgpl ?v?3(?: 0)?"]),
    ("lgpl-2.1", "gnu lgpl 2 1", "lesser general public licen", [rf"(?:gnu )?lesser general public license{VERSION} 2 1"]),
    ("lgpl-3.0", "gnu lgpl 3", "lesser general public licen", [rf"(?:gnu )?lesser general public license{VERSION} 3(?: 0)?"]),
    ("lgpl", "lgpl", "lesser general public licen", ["(?:gnu )?lesser general public license"]),
    ("lgpl-2.0", "gnu lgpl 2", "library general public licen", ["(?:gnu )?library general public license"]),
    ("agpl-3.0", "agpl 3 0(?: only| or later)?", "agpl", ["(?:gnu )?agpl ?v?3(?: 0)?"]),
    ("agpl-3.0", "gnu agpl 3", "affero general public licen", [rf"(?:gnu )?affero general public license(?:{VERSION} 3(?: 0)?)?"]),
    ("gfdl-1.3", "gfdl 1 3", "licen", [rf"(?:gnu )?free documentation license(?:{VERSION} 1 3)?"]),
    ("bsd-1-clause", "bsd 1 clause", "bsd", ["bsd 1 clause(?: license)?"]),
    ("bsd-2-clause", "bsd 2 clause", "bsd", ["(?:simplified|freebsd) bsd license", "bsd 2 clause(?: license)?", "2 clause bsd(?: license)?"]),
    ("bsd-3-clause", "bsd 3 clause", "bsd", ["(?:new|modified|revised) bsd license", "bsd 3 clause(?: license)?", "3 clause bsd(?: license)?"]),
    ("bsd-4-clause", "bsd 4 clause", "bsd", ["original bsd license", "bsd 4 clause(?: license)?"]),
    ("bsd", "bsd", "bsd licen", ["(?:the )?bsd license"]),
    ("0bsd", "0bsd", "bsd", ["zero clause bsd(?: license)?", "bsd zero clause(?: license)?"]),
    ("isc", "isc", "licen", ["(?:the )?isc license"]),
    ("mpl-1.1", "mpl 1 1", "licen", [rf"mozilla public license{VERSION} 1 1"]),
    ("mpl-2.0", "mpl 2 0", "licen", [rf"mozilla public license{VERSION} 2(?: 0)?"]),
    ("mpl", "mpl", "licen", ["mozilla public license"]),
    ("epl-1.0", "epl 1 0", "licen", [rf"eclipse public license{VERSION} 1(?: 0)?"]),
    ("epl-2.0", "epl 2 0", "licen", [rf"eclipse public license{VERSION} 2(?: 0)?"]),
    ("epl", "epl", "licen", ["eclipse public license"]),
    ("edl-1.0", "edl 1 0", "licen", ["eclipse distribution license"]),
    ("cddl-1.0", "cddl 1 0", "licen", [rf"common development and distribution license(?:{VERSION} 1 0)?"]),
    ("cpl-1.0", "cpl 1 0", "licen", [rf"common public license(?:{VERSION} 1 0)?"]),
    ("cpal-1.0", "cpal 1 0", "licen", ["common public attribution license"]),
    ("eupl-1.2", "eupl 1 2", "licen", [rf"european union public license(?:{VERSION} 1 2)?"]),
    ("osl-3.0", "osl 3 0", "licen", [rf"open software license(?:{VERSION} 3 0)?"]),
    ("afl-3.0", "afl 3 0", "licen", [rf"academic free license(?:{VERSION} 3 0)?"]),
    ("artistic-1.0", "artistic 1 0", "licen", [rf"artistic license{VERSION} 1(?: 0)?"]),
    ("artistic-2.0", "artistic 2 0", "licen", [rf"artistic license(?:{VERSION} 2(?: 0)?)?"]),
    ("bsl-1.0", "bsl 1 0", "licen", [rf"boost software license(?:{VERSION} 1(?: 0)?)?"]),
    ("busl-1.1", "busl 1 1", "licen", [rf"business source license(?:{VERSION} 1 1)?"]),
    ("sspl-1.0", "sspl 1 0", "licen", ["server side public license"]),
    ("elastic-2.0", "elastic 2 0", "licen", [rf"elastic license(?:{VERSION} 2(?: 0)?)?"]),
    ("zlib", "zlib", "licen", ["zlib(?: libpng)? license"]),
    ("libpng", "libpng", "licen", ["libpng license"]),
    ("unlicense", "unlicense", "unlicense", ["(?:the )?unlicense"]),
    ("wtfpl", "wtfpl", "wtfpl", ["wtfpl"]),
    ("ncsa", "ncsa", "licen", ["university of illinois ncsa open source license", "ncsa(?: open source)? license"]),
    ("psf-2.0", "psf 2 0", "licen", ["python software foundation license", "psf license"]),
    ("php-3.01", "php 3 01", "licen", [rf"php license(?:{VERSION} 3 01)?"]),
    ("ruby", "ruby", "licen", ["ruby license"]),
    ("openssl", "openssl", "licen", ["openssl license"]),
    ("vim", "vim", "licen", ["vim license"]),
    ("curl", "curl", "licen", ["curl license"]),
    ("json", "json", "licen", ["json license"]),
    ("postgresql", "postgresql", "licen", ["postgresql license"]),
    ("upl-1.0", "upl 1 0", "licen", ["universal permissive license"]),
    ("ms-pl", "ms pl", "licen", ["microsoft public license"]),
    ("ms-rl", "ms rl", "licen", ["microsoft reciprocal license"]),
    ("ofl-1.1", "ofl 1 1", "licen", [rf"(?:sil )?open font license(?:{VERSION} 1 1)?"]),
    ("odbl-1.0", "odbl 1 0", "licen", ["open(?: data commons)? database license"]),
    ("odc-by-1.0", "odc by 1 0", "licen", ["open data commons attribution license"]),
    ("pddl-1.0", "pddl 1 0", "licen", ["public domain dedication and license"]),
    ("cc0-1.0", "cc0 1 0", "cc0", ["cc0(?: 1 0)?(?: universal)?"]),
    ("public-domain", "public domain", "public domain", ["(?:in|to|into) the public domain", "public domain dedication"]),
    ("cecill-2.1", "cecill 2 1", "licen", ["cecill(?: free software)? license"]),
    ("hpnd", "hpnd", "licen", ["historical permission notice and disclaimer license"]),
    ("ncgl", "ncgl", "licen", ["non commercial government license"]),
    ("ogl-uk-3.0", "ogl uk 3 0", "licen", [r"open government licence(?: v ?3(?: 0)?)?"]),
    ("rail-m", "rail m", "licen", ["(?:open ?rail m?|responsible ai) license"]),
    ("proprietary", "proprietary", "licen", ["end user license agreement", "proprietary license", "commercial license"]),
)
#: Creative Commons, by a rule: the clauses and the versions.
CLAUSES = {"by": "attribution", "by sa": "attribution share ?alike", "by nd": "attribution no ?deriv(?:ative)?s", "by nc": "attribution non ?commercial", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s"}
VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

GRANT = r"(?:licensed|released|distributed|published|provided|available|covered|offered)(?: [^ ]+){0,3}? under(?: the)?(?: terms of)?(?: the)? "
TAG = r"spdx license identifier "
#: How sure a detection of each priority is.
SURE = {1: 0.99, 2: 0.95, 3: 0.7}
END = "(?= |$)"
MARK = "\x01"
#: Rules whose patterns are tried as one before each by itself.
TOGETHER = 8


def rules() -> list[tuple[int, str, str, str]]:
    """(priority, keyword, pattern, label) of every rule, in order of priority."""
    out = []
    table = list(LICENSES)
    for short, name in CLAUSES.items():
        for v in VERSIONS:
            label = f"cc-{short.replace(' ', '-')}-{v.replace(' ', '.')}"
            table.append((label, f"cc {short} {v}", "cc by", [f"cc {short} {v}(?: license)?"]))
            table.append((label, f"cc {short} {v}", "creative commons", [f"creative commons {name} {v}"]))
    for label, tag, keyword, names in table:
        out.append((1, "spdx", TAG + tag, label))
        for name in (n.replace("license", "licen[sc]e") for n in names):  # either spelling
            out.append((2, keyword, GRANT + name, label))
            out.append((3, keyword, name, label))
    return sorted(set(out))


def words(text: Column) -> Column:
    """The words of a text, in lower case (of ASCII letters at least), each after one space.

    lower() changes other letters as well, which no rule sees: none becomes a separator, and the one
    that would become an ASCII letter by itself, the Kelvin sign, is replaced before.
    """
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.rtrim(F.regexp_replace(F.concat(F.lit(" "), lowered), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def spaces(words: Column) -> Column:
    return F.octet_length(words) - F.octet_length(F.replace(words, F.lit(" "), F.lit("")))


def phrase_columns(words: Column, n_words: Column) -> dict[str, Column]:
    """n_base, first_word, last_word and base_labels."""
    count, first, last, labels = [], [], [], []
    for phrase, label in BASE:
        there = F.contains(words, F.lit(f" {phrase}"))
        pieces = F.split(words, f" {phrase}{END}", -1)
        n = F.when(there, F.size(pieces) - 1).otherwise(0)
        count.append(n)
        first.append(F.when(there & (n > 0), spaces(pieces[0])))
        last.append(F.when(there & (n > 0), n_words - spaces(F.element_at(pieces, -1)) - len(phrase.split())))
        labels.append(F.when(n > 0, F.lit(label)))
    return {
        "n_base": reduce(Column.__add__, count).cast("long"),
        "first_word": F.array_min(F.array(*first)).cast("long"),
        "last_word": F.array_max(F.array(*last)).cast("long"),
        "base": F.array_compact(F.array(*labels)),
    }


def gated(words: str) -> Column:
    """The rules' matches in a column of words: array of (priority, label, pieces), pieces being the words cut at a rule's matches.

    Patterns are literals, so each is compiled once a task. Three gates stand before a rule: a keyword in the text, an alternation of
    TOGETHER rules, and the rule itself; a text that names one license tries a few dozen rules, one without a keyword none.
    """
    groups: dict[tuple[str, int], list[tuple[str, str]]] = {}
    for priority, keyword, pattern, label in rules():
        groups.setdefault((keyword, priority), []).append((pattern, label))
    text, found = F.col(words), []
    none = F.array().cast("array<struct<priority: int, label: string, pieces: array<string>>>")

    def tried(pattern: str, label: str, priority: int) -> Column:
        # MARK before and after each match; no word holds it, so every second piece is a match.
        marked = F.regexp_replace(text, F.lit(f"( {pattern}){END}"), F.lit(f"{MARK}$1{MARK}"))
        return F.struct(F.lit(priority).alias("priority"), F.lit(label).alias("label"), F.split(marked, MARK, -1).alias("pieces"))

    for (keyword, priority), patterns in sorted(groups.items()):
        some = []
        for i in range(0, len(patterns), TOGETHER):
            part = patterns[i : i + TOGETHER]
            either = f" (?:{'|'.join(f'(?:{p})' for p, _ in part)}){END}"
            some.append(F.when(F.rlike(text, F.lit(either)), F.array(*[tried(p, label, priority) for p, label in part])).otherwise(none))
        opening = F.contains(text, F.lit(f" {keyword}"))
        if priority == 1:
            opening &= F.contains(text, F.lit(f" {TAG}"))
        elif priority == 2:
            opening &= F.rlike(text, F.lit(f" {GRANT}"))
        found.append(F.when(opening, F.flatten(F.array(*some))).otherwise(none))
    return F.flatten(F.array(*found))


def detections(gated: str) -> Column:
    """Of a column of ``gated`` rules: array of (start, end, priority, label), in order of start, longest first."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("nth"), F.array().cast("array<struct<start: int, to: int>>").alias("found"))

    def step(s: Column, piece: Column) -> Column:
        then = s["at"] + spaces(piece)
        match = F.array(F.struct(s["at"].alias("start"), (-then).alias("to")))
        return F.struct(then.alias("at"), (s["nth"] + 1).alias("nth"), F.when(s["nth"] % 2 == 1, F.concat(s["found"], match)).otherwise(s["found"]).alias("found"))

    def places(r: Column) -> Column:
        found = F.aggregate(r["pieces"], start, step, lambda s: s["found"])
        return F.transform(found, lambda d: F.struct(d["start"].alias("start"), d["to"].alias("to"), r["priority"].alias("priority"), r["label"].alias("label")))

    # Sorted as (start, -end, priority, label).
    several = F.filter(F.col(gated), lambda r: F.size(r["pieces"]) > 1)
    keyed = F.array_sort(F.flatten(F.transform(several, places)))
    return F.transform(keyed, lambda d: F.struct(d["start"].alias("start"), (-d["to"]).alias("end"), d["priority"].alias("priority"), d["label"].alias("label")))


def surviving(found: str) -> Column:
    """Of the detections in order: the labels of those that none within reach suppresses, and how doubtful they all are."""
    none = F.lit(-1)
    start = F.struct(F.array().cast("array<string>").alias("labels"), F.lit(1.0).alias("doubt"), none.alias("e1"), none.alias("e2"), none.alias("e3"))

    def step(s: Column, d: Column) -> Column:
        reach = F.when(d["priority"] == 1, s["e1"]).when(d["priority"] == 2, s["e2"]).otherwise(s["e3"])
        out = reach >= d["end"]
        sure = F.when(d["priority"] == 1, 1 - SURE[1]).when(d["priority"] == 2, 1 - SURE[2]).otherwise(1 - SURE[3])
        # e1, e2, e3: the farthest end so far of a detection of priority 1, up to 2, up to 3.
        ends = [F.when(d["priority"] <= p, F.greatest(s[f"e{p}"], d["end"])).otherwise(s[f"e{p}"]).alias(f"e{p}") for p in (1, 2, 3)]
        return F.struct(F.when(out, s["labels"]).otherwise(F.array_union(s["labels"], F.array(d["label"]))).alias("labels"), F.when(out, s["doubt"]).otherwise(s["doubt"] * sure).alias("doubt"), *ends)

    return F.aggregate(F.col(found), start, step)


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    base columns: the places of the base phrases, as words from 0 (null if none). labels: those and
    the labels of surviving detections, distinct, sorted, comma-joined; score: how sure it is that
    the text names a license, 0 if nothing is found; detections: all of them, suppressed or not, by
    words [start, end). A null or empty text has 0 words and nothing else. Rows that repeat stay.
    """
    w = only(docs, [id_col, text_col]).select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    w = w.withColumn("n_words", spaces(F.col("w")).cast("long"))
    for name, column in phrase_columns(F.col("w"), F.col("n_words")).items():
        w = w.withColumn(name, column)
    gate = reduce(Column.__or__, [F.contains("w", F.lit(f" {k}")) for k in _gates()])
    empty = F.array().cast("array<struct<start: int, end: int, priority: int, label: string>>")
    w = w.withColumn("gated", F.when(gate, gated("w")))
    w = w.withColumn("detections", F.when(F.size("gated") > 0, detections("gated")).otherwise(empty))
    w = w.withColumn("kept", F.when(F.size("detections") > 0, surviving("detections")))
    found = F.coalesce("kept.labels", F.array().cast("array<string>"))
    sure = F.when(F.col("n_base") > 0, F.lit(SURE[3])).otherwise(F.lit(0.0))
    return w.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", found)), ",").alias("labels"),
        F.greatest(sure, F.round(1 - F.coalesce("kept.doubt", F.lit(1.0)), 6)).alias("score"),
        "detections",
    )


def _gates() -> list[str]:
    """The keywords that no other one begins with."""
    keys = {k for _, k, _, _ in rules()}
    return sorted(k for k in keys if not any(k != x and k.startswith(x) for x in keys))
