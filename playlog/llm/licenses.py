"""Licence scans by canonical digest.

A text is put in canonical form (case, punctuation, copyright lines and equivalent
spellings are made alike) and its SHA-256 is looked up, by a hash join, among the
digests of known licence texts in the same form.  The units looked up are the whole
document, each of its lines, since notices mostly stand on a line of their own, and the
stretches that begin with the first words of a full text and have its length, wherever
they stand and however they are wrapped.  Digests are only made of units whose canonical
length is that of a known text.

Known are KNOWN, which the SQL has too, the full texts in the folder license_texts
(NAME.txt, with variants as NAME@2.txt) and the notices of NOTICES.  They are matched in a
form that also makes alike what licences leave to their user (holders, the numbers of
clauses, the verb of a notice), without title, and drops only lines that name a holder or
a year, not every line that begins with the word copyright.  The table is a parameter of fixed size, so it is broadcast.

Defined results: null text is the empty text, which matches nothing.  `licenses` lists
the matches of lines in order, repeated if a line repeats, and then those of stretches
that are neither one of these lines nor the whole text; `license` is the whole text's
match or null.  `digest` is that of the form that the SQL has, and what the SQL matches
in that form stays matched.  Repeated rows give repeated results, apart from each other.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlog.llm._spark import table, texts_of

# Known texts, by name.
KNOWN = {
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """MIT License

Copyright (c) the authors

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "Reserved notice": "All rights reserved.",
}
# Spellings taken as equal, as patterns over lower-case words parted by one space.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("https", "http"),
    ("copyright owner", "copyright holder"),
)
_COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©)[^\n]*$"
_MARKS = r"[^\p{L}\p{N}]+"
_TEXTS = Path(__file__).with_name("license_texts")
_END = "END OF TERMS AND CONDITIONS"

# Names of licences as they stand in notices, lower case without marks.
_GNU = {"GPL": ("gnu general public license", "gnu gpl", "gpl", "general public license"), "LGPL": ("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl", "lesser general public license"), "AGPL": ("gnu affero general public license", "gnu agpl", "agpl", "affero general public license"), "GFDL": ("gnu free documentation license", "gnu fdl", "gfdl")}
_GNU_VERSIONS = {"GPL": ("1.0", "2.0", "3.0"), "LGPL": ("2.0", "2.1", "3.0"), "AGPL": ("3.0",), "GFDL": ("1.1", "1.2", "1.3")}
_CC = {"BY": "attribution", "BY-SA": "attribution sharealike", "BY-NC": "attribution noncommercial", "BY-ND": "attribution noderivatives", "BY-NC-SA": "attribution noncommercial sharealike", "BY-NC-ND": "attribution noncommercial noderivatives"}
_NAMES = {
    "MIT": ("mit", "mit x11", "expat", "x11"),
    "ISC": ("isc",),
    "0BSD": ("0bsd", "bsd zero clause", "zero clause bsd", "bsd 0 clause"),
    "BSD-2-Clause": ("bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd", "two clause bsd", "bsd two clause"),
    "BSD-3-Clause": ("bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd", "three clause bsd", "bsd three clause"),
    "BSD": ("bsd", "bsd style"),
    "Zlib": ("zlib", "zlib libpng"),
    "BSL-1.0": ("boost software", "boost software license version 1 0", "boost software license 1 0", "bsl 1 0"),
    "Unlicense": ("unlicense",),
    "WTFPL": ("wtfpl", "do what the fuck you want to public"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache license version 2", "apache 2 0", "apache 2", "apache v2", "apache v2 0", "apache software license version 2 0", "apache software license 2 0", "apache version 2 0"),
    "MPL-1.1": ("mozilla public license version 1 1", "mozilla public license 1 1", "mozilla public license v1 1", "mpl 1 1"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0", "mozilla public license v2 0", "mpl 2 0", "mpl2", "mpl v2 0"),
    "EPL-1.0": ("eclipse public license version 1 0", "eclipse public license 1 0", "eclipse public license v1 0", "epl 1 0"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v2 0", "epl 2 0"),
    "Artistic-2.0": ("artistic license 2 0", "artistic license version 2 0"),
    "OFL-1.1": ("sil open font license version 1 1", "sil open font license 1 1", "ofl 1 1"),
    "CC0-1.0": ("cc0", "cc0 1 0", "cc0 1 0 universal", "creative commons zero", "creative commons cc0 1 0 universal", "creative commons zero v1 0 universal"),
}


def notices() -> dict[str, str]:
    """Name by notice, in the form that `_noticed` gives: licensed under the <licence>."""
    called = {f"{name} notice": list(x) for name, x in _NAMES.items()}
    for family, titles in _GNU.items():
        for version in _GNU_VERSIONS[family]:
            spelt = version.replace(".", " ")
            short = {spelt, spelt.removesuffix(" 0")}
            for ending, words in (("", ("", " only")), ("-or-later", (" or later", " or any later version", " or at your option any later version", " or newer"))):
                called[f"{family}-{version}{ending} notice"] = [f"{t}{v}{n}{w}" for t in titles for v in (" version ", " v", " v ", " ", "v") for n in short for w in words] + [f"{family.lower()}{v}{n}+" for v in (" v", " ", "v") for n in short if ending]
    for short, long in _CC.items():
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            n, s = version.replace(".", " "), short.lower().replace("-", " ")
            longs = {long, long.replace("sharealike", "share alike").replace("noncommercial", "non commercial").replace("noderivatives", "no derivatives")}
            ends = ("", " international", " unported") if version in ("3.0", "4.0") else ("", " generic")
            called[f"CC-{short}-{version} notice"] = [f"{t} {n}{e}" for t in (f"cc {s}", f"creative commons {s}", *(f"creative commons {x}" for x in longs), *(f"creative commons {x} license version" for x in longs)) for e in ends]
    out: dict[str, str] = {}
    for name, titles in called.items():
        for t in titles:
            for x in (t, f"{t} license") if not t.endswith(" license") else (t,):
                out.setdefault("licensed under the " + x.replace("+", ""), name)
    return out


def known_texts() -> list[tuple[str, str]]:
    """(name, text) of all that is looked up; texts that tell users how to apply them
    count with that part and without."""
    out = list(KNOWN.items())
    for path in sorted(_TEXTS.glob("*.txt")):
        name, text = path.stem.split("@")[0], path.read_text(encoding="utf-8")
        head, mark, _ = text.partition(_END)
        out += [(name, x) for x in ((text, head, head + mark) if mark else (text,))]
    return out + [(name, text) for text, name in notices().items()]


# A notice says (c), a year or a holder; what follows the word in licences themselves isn't one.
_BODY = "notices?|holders?|owners?|licen[sc]es?|licensors?|laws?|acts?|interests?|statements?|lines?|and|or|of|in|is|to|on|for|as|that|which|treaty|treaties|protection|doctrines?|disclaimer|rights?|permissions?|information|material|related|status|under|with|does|may|can|will|shall|if|applies|resulting|the (?:software|library|program)|infringement|assignment|year|years|from|at|are|was|has|have|restrictions|resides|it|its|this|these|those|not|but|when|where|who|whose|within|without|unless|any|all|such|being|be|including|ownership"
_HELD = (
    r"(?:portions[ \t]+)?copyright[ \t]*(?:\(c\)|©)",
    r"copyright[ \t:,]*[\[<{(]?[ \t]*(?:(?:19|20)[0-9]{2}|year|yyyy)(?![\p{L}\p{N}])",
    rf"copyright[ \t:]+(?!(?:{_BODY})(?![\p{{L}}\p{{N}}]))[\p{{L}}<\[{{]",
    r"\(c\)[ \t]*(?:copyright|(?:19|20)[0-9]{2}|[<\[{])",
    "©",
)
_HOLDERS = r"(?m)^[^\p{L}\p{N}\n]*(?:" + "|".join(_HELD) + r")[^\n]*$(?:\n[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$)?"


def canonical(text: Column, notices: str | None = _COPYRIGHT) -> Column:
    """Lower case, without copyright lines, words parted by one space, spellings alike."""
    out = F.regexp_replace(F.lower(text), notices, " ") if notices else F.lower(text)
    out = F.trim(F.regexp_replace(out, _MARKS, " "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


# Titles, which may stand above a licence or not, over lower-case words.
_TITLE = (
    "^(?:(?:(?:the )?(?:mit|isc|mit x11|x11|expat|zlib|0bsd|(?:new |modified |revised |simplified |original )?bsd(?: (?:zero|two|three|[0-4]) clause| style)?|(?:zero|two|three|[0-4]) clause bsd) license(?: (?:mit|isc|0bsd|zlib|bsd [0-4] clause))?"
    "|(?:the )?unlicense|apache license version 2 0(?: january 2004)?(?: http (?:www )?apache org licenses(?: license 2 0)?)?"
    "|mozilla public license version [0-9] [0-9]|creative commons legal code|cc0 1 0 universal|(?:creative commons )?attribution sharealike 4 0 international"
    "|sil open font license version 1 1 26 february 2007|unicode license v3|(?:the )?artistic license) )+"
)
_GNU_TITLE = "^gnu [a-z ]{4,40}license .{0,200}?(?=everyone is permitted to copy)"


def untitled(form: Column) -> Column:
    """A canonical text without its title, and for GNU's without the holder's address."""
    bare = F.regexp_replace(F.regexp_replace(form, _TITLE, ""), _GNU_TITLE, "")
    return F.when(form.rlike("^(?:the |new |modified |revised |simplified |original |zero |two |three |creative |attribution |mit|isc|x11|expat|zlib|0bsd|bsd|[0-4] |unlicense|apache|mozilla|cc0|sil|unicode|artistic|gnu)"), bare).otherwise(form)


# What users of a licence fill in or choose, over lower-case words.
_FILLED = (
    (r"neither the names? .{1,160}? nor the names? of (?:(?:its|their|any|other) )*contributors", "neither the name of the holder nor the names of its contributors"),
    (r"software is provided by .{1,120}? as is and any express", "software is provided by the holder as is and any express"),
    (r"in no event shall .{1,120}? be liable for", "in no event shall the holder be liable for"),
    (r"(?<![^ ])(?:[0-9]{1,2}|[a-c]|i{1,3}) (?=redistributions (?:of source|in binary)|neither the name)", ""),
)
_NOTICE = r"^(?:(?:this|the) (?:[a-z]+ ){1,3}(?:is|are) )?(?:dual )?(?:licensed|released|distributed|available|made available|published|provided|covered) under (?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?"


def _noticed(form: Column) -> Column:
    out = F.regexp_replace(form, _NOTICE, "licensed under the ")
    return F.regexp_replace(F.regexp_replace(out, r"^spdx license identifier ", "licensed under the "), r"^(licensed under the .*version .*) of the license$", "$1")


def filled(form: Column) -> Column:
    """`canonical` texts with what their users fill in made alike."""
    out = form
    for a, b in _FILLED:
        out = F.regexp_replace(out, a, b)
    return F.when(form.contains("redistributions") | form.contains("in no event shall"), out).otherwise(form)


def noticed(form: Column) -> Column:
    return F.when(form.contains(" under ") | form.startswith("spdx "), _noticed(form)).otherwise(form)


def known_digests(spark: SparkSession, known: list[tuple[str, str]], form: Callable[[Column], Column]) -> DataFrame:
    """`name`, `size`, `digest` and the first words (`head`) of each known text's form."""
    texts = spark.createDataFrame(known, "name string, text string").select("name", form(F.col("text")).alias("form"))
    return texts.select("name", F.length("form").alias("size"), F.sha2("form", 256).alias("digest"), F.substring_index("form", " ", _HEAD).alias("head")).groupBy("size", "digest", "head").agg(F.min("name").alias("name"))


#: Words that a full text is looked for by, and the least length of its form.
_HEAD, _LONG = 5, 200


def stretches(forms: DataFrame, rows: list[tuple[str, int, str, str]]) -> DataFrame:
    """`doc_id`, `key`, `place` and `name` of the full texts (name, size, digest, head) that
    stand in a longer `form`; of several from one place the longest."""
    spark, most = forms.sparkSession, max((r[1] for r in rows), default=0)
    full = F.broadcast(spark.createDataFrame(rows, "name string, size int, digest string, head string"))
    heads = "|".join(sorted({r[3] for r in rows})) or "(?!)"
    parts = forms.where(F.col("form").rlike(f"(?<![^ ])(?:{heads})(?![^ ])")).withColumn("parts", F.split("form", f"(?<![^ ])(?=(?:{heads})(?![^ ]))"))
    begins = F.aggregate("parts", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.get(a, F.size(a) - 1) + F.length(x))))
    at = parts.select("doc_id", "key", "form", F.explode(F.array_distinct(begins)).alias("place"))
    tails = at.select("doc_id", "key", "place", F.length("form").alias("length"), F.col("form").substr(F.col("place") + 1, F.lit(most + 1)).alias("tail")).withColumn("head", F.substring_index("tail", " ", _HEAD))
    same = (F.sha2(F.col("tail").substr(F.lit(1), F.col("size")), 256) == F.col("digest")) & F.col("tail").substr(F.col("size") + 1, F.lit(1)).isin("", " ")
    found = tails.join(full, "head").where((F.col("size") < F.col("length")) & same)
    return found.groupBy("doc_id", "key", "place").agg(F.max_by("name", "size").alias("name"))


def _bare(text: Column) -> Column:
    held = F.lower(text).rlike(r"copyright|\(c\)|©")
    return F.when(held, canonical(text, _HOLDERS)).otherwise(canonical(text, None))


def _forms(texts: Column) -> Column:
    """Step by step, as an expression that names another twice would make it twice."""
    for step in (_bare, untitled, filled, noticed):
        texts = F.transform(texts, step)
    return texts


def _form(text: Column) -> Column:
    return F.get(_forms(F.array(text)), F.lit(0))


def scan(docs: DataFrame, known: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `digest` of the whole canonical text, `license` and `licenses`."""
    spark = docs.sparkSession
    listed = known_texts() if known is None else list(known.items())
    # A few hundred rows, kept by the driver so that no task makes their forms again.
    rows = known_digests(spark, listed, _form).collect()
    sizes = F.array(*[F.lit(x) for x in sorted({r["size"] for r in rows})] or [F.lit(-1)])
    names = F.broadcast(spark.createDataFrame([(r["digest"], r["name"]) for r in rows], "digest string, name string"))
    plain = F.broadcast(known_digests(spark, list((KNOWN if known is None else known).items()), canonical).select("digest", F.col("name").alias("plain")))
    texts = texts_of(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    both = texts.select("doc_id", "key", F.sha2(canonical(F.col("text")), 256).alias("digest"), F.sha2(_form(F.col("text")), 256).alias("form"))
    whole = both.join(plain, "digest", "left").join(names.select(F.col("digest").alias("form"), F.col("name").alias("found")), "form", "left").select("doc_id", "key", "digest", F.coalesce("plain", "found").alias("license"))
    lines = F.filter(_forms(F.split("text", "\n")), lambda x: F.array_contains(sizes, F.length(x)))
    units = texts.select("doc_id", "key", F.posexplode(lines).alias("place", "line")).select("doc_id", "key", "place", F.sha2("line", 256).alias("digest"))
    longer = stretches(texts.select("doc_id", "key", _form(F.col("text")).alias("form")), [(r["name"], r["size"], r["digest"], r["head"]) for r in rows if r["size"] >= _LONG])
    ranked = units.join(names, "digest").select("doc_id", "key", F.lit(0).alias("rank"), "place", "name").unionByName(longer.withColumn("rank", F.lit(1)))
    hits = ranked.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("rank", "place", "name"))).alias("hits"))
    first, second = F.filter("hits", lambda x: x["rank"] == 0), F.filter("hits", lambda x: x["rank"] == 1)
    hits = hits.select("doc_id", "key", first["name"].alias("lined"), second["name"].alias("longer"))
    # A full text on one line is among both.
    more = F.filter("longer", lambda x, i: F.size(F.filter(F.slice("longer", 1, i + 1), lambda y: y == x)) > F.size(F.filter("lined", lambda y: y == x)))
    found = hits.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.array_join(F.concat("lined", more), ",").alias("licenses"))
    joined = whole.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    return joined.select("doc_id", "digest", "license", F.coalesce("licenses", F.lit("")).alias("licenses"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    def form(x: str) -> str:
        copyright_ = _COPYRIGHT.replace("(?m)", "")
        out = f"trim(regexp_replace(regexp_replace(lower({x}), '{copyright_}', ' ', 'gm'), '{_MARKS}', ' ', 'g'))"
        for a, b in SPELLINGS:
            out = f"replace({out}, '{a}', '{b}')"
        return out

    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(KNOWN.items()))
    return f"""
WITH known AS (SELECT sha256({form("text")}) AS digest, min(name) AS name FROM (VALUES {values}) v(name, text) GROUP BY 1),
docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT k, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS place FROM docs),
found AS (SELECT k, string_agg(name, ',' ORDER BY place) AS licenses
          FROM (SELECT k, place, sha256({form("line")}) AS digest FROM lines) JOIN known USING (digest) GROUP BY k),
whole AS (SELECT k, doc_id, sha256({form("text")}) AS digest FROM docs)
SELECT doc_id, whole.digest, known.name AS license, coalesce(licenses, '') AS licenses
FROM whole LEFT JOIN known USING (digest) LEFT JOIN found USING (k)"""


QUERIES = {"op6_licenses": op6_licenses}
ORACLES = {"op6_licenses": _sql()}
