"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, inherited from the nearest directory."""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Templates of licence headers. Fixed values.
TEMPLATES = {
    "Apache-2.0": "licensed under the apache license version 2.0",
    "MIT": "released under the mit license",
    "GPL-3.0": "this work is licensed under the gnu general public license version 3",
    "CC-BY-NC-4.0": "licensed under cc by nc 4.0",
    "CC-BY-4.0": "licensed under cc by 4.0",
    "BSD-3-Clause": "redistribution and use in source and binary forms are permitted under the bsd license",
    "MPL-2.0": "this source code form is subject to the terms of the mozilla public license version 2.0",
    "Proprietary": "all rights reserved",
}
#: Whole licences, each in a file named by its SPDX id.
TEXTS = {p.stem: p.read_text(encoding="utf-8") for p in sorted(Path(__file__).with_name("licence_texts").glob("*.txt"))}
#: Usual headers of source files, and titles. Fixed values.
HEADERS = [
    ("Apache-2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www.apache.org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("GPL-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see https www.gnu.org licenses"),
    ("GPL-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not write to the free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v. 2.0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0"),
    ("Apache-2.0", "apache license version 2.0 january 2004"),
    ("Apache-2.0", "apache license version 2.0"),
    ("MIT", "mit license"),
    ("MIT", "the mit license mit"),
    ("BSD-2-Clause", "bsd 2 clause license"),
    ("BSD-3-Clause", "bsd 3 clause license"),
    ("GPL-2.0", "gnu general public license version 2 june 1991"),
    ("GPL-3.0", "gnu general public license version 3 29 june 2007"),
    ("LGPL-2.1", "gnu lesser general public license version 2.1 february 1999"),
    ("LGPL-3.0", "gnu lesser general public license version 3 29 june 2007"),
    ("MPL-2.0", "mozilla public license version 2.0"),
    ("CC-BY-4.0", "creative commons attribution 4.0 international public license"),
    ("CC-BY-NC-4.0", "creative commons attribution noncommercial 4.0 international public license"),
    ("CC0-1.0", "creative commons legal code cc0 1.0 universal"),
]
#: What an SPDX line names: one id, or several by OR, AND and WITH.
SPDX = r"(?i)spdx-license-identifier:\s*\(?([a-z0-9.+-]*[a-z0-9+](?:\s+(?:or|and|with)\s+[a-z0-9.+-]*[a-z0-9+])*)"
#: A line is a header if it names one of these. Fixed value.
NAMES = "licen[cs]e|copyright|spdx|all rights reserved"


def terms(text: Column) -> Column:
    """Lower-case words of letters, digits and inner points."""
    return F.filter(F.split(F.rtrim(F.regexp_replace(F.lower(text), "[^a-z0-9.]+|[.](?=[^0-9]|$)", " ")), " "), lambda w: F.length(w) > 0)


#: So many matched texts at most are broadcast to the files that have them; more meet them in so many tasks a text.
BROADCAST_UNITS, SALTS = 50_000, 16
#: Which templates each kind of piece meets: whole texts, blocks, and lines (sentences, then titles).
SETS = {1: list(TEXTS.items()), 2: [*TEXTS.items(), *HEADERS], 3: list(TEMPLATES.items()), 4: HEADERS}


def template_vectors() -> tuple[list[tuple], list[tuple]]:
    """Of the fixed templates: (kind, term, weight, [(name, value)]) and (kind, weight of terms of no template)."""
    rows, unknown = [], []
    for kind, templates in SETS.items():
        counts = [Counter(re.sub(r"[^a-z0-9.]+|[.](?=[^0-9]|$)", " ", text.lower()).split()) for _, text in templates]
        idf = {term: math.log((1 + len(counts)) / (1 + n)) + 1 for term, n in Counter(t for c in counts for t in c).items()}
        weighed = [{t: (math.log(n) + 1) * idf[t] for t, n in c.items()} for c in counts]
        norm = [math.sqrt(sum(w * w for w in v.values())) for v in weighed]
        for term, w in idf.items():
            rows.append((kind, term, w, [(at, templates[at][0], v[term] / norm[at]) for at, v in enumerate(weighed) if term in v]))
        unknown.append((kind, math.log((1 + len(counts)) / 2) + 1))
    return rows, unknown


def nearest_templates(units: DataFrame, least: float) -> DataFrame:
    """kind, unit, name and score of the nearest template to each of ``units(kind, unit, text)``, if ``least`` or more; ties by name.

    Vectors are sparse: a unit's terms are counted, weighed, and joined with the templates' on the term; a unit's square is summed with its products.
    """
    spark = units.sparkSession
    rows, unknown = template_vectors()
    known = F.broadcast(spark.createDataFrame(rows, "kind int, term string, w double, parts array<struct<at:int,name:string,value:double>>"))
    none = F.create_map(*(F.lit(x) for pair in unknown for x in pair))
    found = units.select("kind", "unit", F.explode(terms(F.col("text"))).alias("term")).groupBy("kind", "unit", "term").agg((F.log(F.count("*").cast("double")) + 1).alias("tf"))
    weighed = found.join(known, ["kind", "term"], "left").withColumn("own", F.col("tf") * F.coalesce("w", none[F.col("kind")]))
    square = F.struct(F.lit(-1).alias("at"), F.lit("").alias("name"), F.col("own").alias("value"))
    parts = weighed.select("kind", "unit", "own", F.explode(F.concat(F.array(square), F.coalesce("parts", F.array().cast("array<struct<at:int,name:string,value:double>>")))).alias("p"))
    dots = parts.groupBy("kind", "unit", "p.at", "p.name").agg(F.sum(F.col("own") * F.col("p.value")).alias("dot"))
    each = dots.groupBy("kind", "unit").agg(F.sum(F.when(F.col("at") < 0, F.col("dot"))).alias("square"), F.collect_list(F.when(F.col("at") >= 0, F.struct((-F.col("dot")).alias("dot"), "name"))).alias("dots"))
    score = F.transform("dots", lambda d: F.struct((F.round(d["dot"] / F.sqrt("square"), 9)).alias("s"), d["name"].alias("name")))
    best = each.select("kind", "unit", F.array_min(score).alias("b")).filter(-F.col("b.s") >= least)
    return best.select("kind", "unit", F.col("b.name").alias("name"), (-F.col("b.s")).alias("score"))


def scan(files: DataFrame, least: float = 0.7, file_share: float = 0.25) -> DataFrame:
    """path, own and own_score (its best match's), licence and inherited_from of every row of ``files(path, text)``.

    What a file itself says is the first of these that it has: an SPDX identifier; a whole text near a whole licence; a block
    of lines (blank lines part blocks) near a licence or a usual header; a line near a sentence of ``TEMPLATES``; a line near a
    title. Only rows, blocks and lines that name a licence are looked at. Terms are weighed by 1 + ln(their number in the text) times ln((1 + templates) /
    (1 + templates with the term)) + 1, and terms of no template as those of one; both vectors are sparse and joined on the term.
    A text takes the template of the largest cosine if that is ``least`` or more, ties by name. A file whose whole text is near
    a licence, or whose words are for ``file_share`` or more in one such block or line, is a licence file: its directory and all
    below it that have no nearer one take its licence. Several in one directory: the best score, then the least name. Files
    without either have nulls, as have null and empty texts. Repeated paths: each row has the best match of all rows of the
    path. A null path keeps its own match and neither gives nor inherits. An empty table gives an empty one.
    """
    keyed = files.select("path", "text")
    size = lambda c: F.size(F.split(c, r"\s+"))
    names = lambda c: F.lower(c).rlike(NAMES)
    whole = F.array(F.struct(F.lit(1).alias("kind"), F.col("text").alias("text")))
    blocks = F.transform(F.filter(F.split("text", r"\n\s*\n"), names), lambda b: F.struct(F.lit(2).alias("kind"), F.trim(F.regexp_replace(b, r"^\s+|\s+$", "")).alias("text")))
    lines = F.transform(F.filter(F.split("text", "\n"), names), lambda b: F.struct(F.lit(3).alias("kind"), F.trim(b).alias("text")))
    every = F.concat(whole, F.filter(blocks, lambda b: b["text"].contains("\n")), lines)
    found = names(F.col("text"))
    # the one scan of the files: their paths, and the pieces of those that name a licence
    seen = checkpoint(keyed.select("path", F.when(found, size(F.col("text"))).alias("words"), F.when(found, every).alias("pieces")))
    naming = seen.filter("pieces is not null").select("path", "words", F.explode("pieces").alias("p"))
    pieces = naming.select("path", "words", "p.kind", "p.text", F.sha2("p.text", 256).alias("unit"), (size(F.col("p.text")) >= file_share * F.col("words")).alias("share"))
    pieces = checkpoint(pieces)
    said = pieces.filter("kind = 3").select("path", F.lit(0).alias("kind"), F.lit(1.0).alias("score"), F.regexp_extract("text", SPDX, 1).alias("name"), F.col("share").alias("is_file")).filter(F.col("name") != "")
    met = pieces.withColumn("kind", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(3), F.lit(4))).otherwise(F.array("kind"))))
    # the same text stands in many files: each distinct one is scored once
    near = checkpoint(nearest_templates(met.groupBy("kind", "unit").agg(F.first("text").alias("text")), least))
    pairs = met.select("path", "kind", "unit", "share", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int").alias("salt"))
    if near.count() <= BROADCAST_UNITS:
        pairs = pairs.join(F.broadcast(near), ["kind", "unit"])
    else:  # a line that a third of all files have meets its template in several tasks
        pairs = pairs.join(near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["kind", "unit", "salt"])
    matched = pairs.select("path", "kind", "score", "name", ((F.col("kind") == 1) | F.col("share")).alias("is_file")).unionByName(said)
    own = matched.groupBy(F.col("path").alias("_p")).agg(F.min(F.struct("kind", (-F.col("score")).alias("s"), "name")).alias("b"), F.max("is_file").alias("is_file"))
    own = checkpoint(own.select("_p", F.col("b.name").alias("own"), (-F.col("b.s")).alias("own_score"), "is_file"))
    folder = F.regexp_replace("_p", "/[^/]*$", "")
    roots = own.filter(F.col("is_file") & F.col("_p").contains("/")).groupBy(folder.alias("folder")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own").alias("name"), F.col("_p").alias("at"))).alias("root"))
    parts = F.split("folder", "/")
    folders = seen.filter(F.col("path").contains("/")).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()
    above = folders.select("folder", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("above")))).alias("a"))
    nearest = above.select("folder", "a.depth", F.col("a.above").alias("above")).join(roots.withColumnRenamed("folder", "above"), "above").groupBy("folder").agg(F.max_by("root", "depth").alias("root"))
    out = seen.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("_f"), F.col("path").contains("/").alias("_in")).join(own, F.col("path").eqNullSafe(F.col("_p")), "left")
    out = out.join(nearest.withColumnRenamed("folder", "_g"), F.col("_in") & (F.col("_f") == F.col("_g")), "left")
    takes = F.col("own").isNull() & F.col("root").isNotNull()
    return out.select("path", "own", "own_score", F.coalesce("own", "root.name").alias("licence"), F.when(takes, F.col("root.at")).alias("inherited_from"))


def document_path() -> Column:
    """Documents have no path: they are laid out by source and, below it, thousands and hundreds of doc_id."""
    number = F.col("doc_id").cast("string")
    return F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 100).cast("string"), number)


_ROWS = ",\n  ".join(f"('{k}', '{v}')" for k, v in TEMPLATES.items())
OP5_SQL = rf"""
WITH t0(name, text) AS (VALUES
  {_ROWS}),
t1 AS (SELECT name, unnest(list_filter(string_split(regexp_replace(text, '[^a-z0-9.]+', ' ', 'g'), ' '), lambda w: w <> '')) AS term FROM t0),
t AS (SELECT name, term, ln(count(*)::DOUBLE) + 1 AS tf FROM t1 GROUP BY ALL),
w AS (SELECT term, ln((1.0::DOUBLE + {len(TEMPLATES)}) / (1.0::DOUBLE + count(*))) + 1 AS w FROM t GROUP BY term),
v AS (SELECT name, term, tf * w AS w, sum(tf * w * tf * w) OVER (PARTITION BY name) AS square FROM t JOIN w USING (term)),
f AS (SELECT doc_id, text, concat_ws('/', coalesce(source, 'unknown'), floor(doc_id / 1000)::BIGINT::VARCHAR, floor(doc_id / 100)::BIGINT::VARCHAR, doc_id::VARCHAR) AS path FROM documents),
h0 AS (SELECT doc_id, path, len(string_split_regex(coalesce(text, ''), '\s+')) AS words, unnest(string_split(text, chr(10))) AS line FROM f),
h AS (SELECT doc_id, path, words, trim(line) AS line FROM h0 WHERE regexp_matches(lower(line), '{NAMES}')),
x0 AS (SELECT line, unnest(list_filter(string_split(regexp_replace(regexp_replace(lower(line), '[^a-z0-9.]+', ' ', 'g'), '[.]( |$)', ' ', 'g'), ' '), lambda w: w <> '')) AS term FROM (SELECT DISTINCT line FROM h)),
x AS (SELECT line, term, ln(count(*)::DOUBLE) + 1 AS tf FROM x0 GROUP BY ALL),
y AS (SELECT x.line, x.term, tf * coalesce(w.w, ln((1.0::DOUBLE + {len(TEMPLATES)}) / 2.0::DOUBLE) + 1) AS w FROM x LEFT JOIN w USING (term)),
q AS (SELECT line, sum(w * w) AS line_square FROM y GROUP BY line),
s AS (SELECT line, name, round(sum(y.w * v.w) / sqrt(square * line_square), 9) AS score FROM y JOIN v USING (term) JOIN q USING (line) GROUP BY line, name, square, line_square),
b AS (SELECT line, name, score, len(string_split_regex(line, '\s+')) AS header_words FROM s WHERE score >= 0.7 QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, name) = 1),
m AS (SELECT h.*, b.name, b.score, header_words >= 0.25 * words AS is_file FROM h JOIN b USING (line)),
o AS (SELECT path, arg_min(name, (-score, name)) AS own, max(score) AS own_score, bool_or(is_file) AS is_file FROM m GROUP BY path),
g AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, arg_min(own, (-own_score, own, path)) AS name, arg_min(path, (-own_score, own, path)) AS place FROM o WHERE is_file GROUP BY 1),
p AS (SELECT doc_id, path, regexp_replace(path, '/[^/]*$', '') AS folder FROM f),
n AS (SELECT k.folder, arg_max(g.name, length(g.folder)) AS name, arg_max(g.place, length(g.folder)) AS place
      FROM (SELECT DISTINCT folder FROM p) k JOIN g ON k.folder = g.folder OR starts_with(k.folder, g.folder || '/') GROUP BY 1)
SELECT p.path, o.own, o.own_score, coalesce(o.own, n.name) AS licence, CASE WHEN o.own IS NULL THEN n.place END AS inherited_from
FROM p LEFT JOIN o USING (path) LEFT JOIN n USING (folder)
"""
