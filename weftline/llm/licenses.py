"""License scan: exact set-similarity join of text blocks with license templates, in DataFrame functions only.

The templates are a constant table, so the join is a map-side one: each row probes it, nothing is shuffled. A
first pass counts in how many documents each template token occurs and orders every template from its rarest
token on. A block matches when it holds at least ``ceil(threshold * size)`` of a template's tokens, hence
(prefix filter) one of its ``size - needed + 1`` rarest. Blocks of a template of n tokens are all windows of 2n
words. A window loses no token when it is moved to its first one, so only windows that start at a template token
are looked at. Before any intersection is taken, texts and windows of fewer than the needed words are passed over
(length filter), and so are windows that lack more of the ``size - needed + LOOK`` rarest tokens than a match may
lack at all: by their ranks in the template, too few tokens are left behind them (positional filter). The others
are verified exactly.

Labels: those of the base phrases, and the templates' own. Score: the greatest containment of a matching block,
1 where a base phrase stands.

Defined results: null text counts as empty and has no words and score 0; places are counted even where they
overlap; repeated rows each get a row; extra columns are ignored; texts are scanned whole.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base phrases with their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Whole public license texts and headers with the label each gives.
LICENSE_TEXTS = (
    (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
        "mit",
    ),
    (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior
        written permission.""",
        "bsd",
    ),
    (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
        "apache-2",
    ),
    (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details.""",
        "gpl-3",
    ),
)

# Notices with the label each gives.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial license", "cc-by-nc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("mozilla public license version 2 0", "mpl-2"),
    ("all rights reserved", "all-rights-reserved"),
    *((" ".join(re.findall("[a-z0-9]+", text.lower())), label) for text, label in LICENSE_TEXTS),
)

LOOK = 8  # tokens looked at beyond the prefix
THRESHOLD = 0.8


def needed_tokens(size: int, threshold: float = THRESHOLD) -> int:
    return math.ceil(threshold * size - 1e-9)


def normalized(text: Column) -> Column:
    """Words of a text, lower-cased, joined by single spaces. U+212A is hidden from lower(), which makes it an ASCII k."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Å")))
    return F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def token_frequency(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """In how many documents each token occurs; at most one row a token comes to the driver."""
    words = F.split(normalized(F.col(text_col)), " ")
    present = docs.select(F.explode(F.array_intersect(F.array(*map(F.lit, vocabulary)), words)).alias("token"))
    return {r[0]: r[1] for r in present.groupBy("token").count().collect()}


def _sql_array(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def _places(phrase: str) -> str:
    """SQL for the starts of a phrase in the array ``words``."""
    parts = phrase.split()
    tests = " AND ".join(f"get(words, i + {k}) = '{w}'" for k, w in enumerate(parts[1:], 1))
    return f"filter(transform(words, (w, i) -> if(w = '{parts[0]}' AND {tests}, i, -1)), i -> i >= 0)"


def _matching_scores(ordered: list[str]) -> str:
    """SQL for the containments of the matching blocks of a template whose tokens are given rarest first."""
    n, need = len(ordered), needed_tokens(len(ordered))
    spare = n - need  # tokens that a match may lack
    looked = ordered[: spare + 1 + LOOK]
    every, prefix, rare = _sql_array(ordered), _sql_array(ordered[: spare + 1]), _sql_array(looked)
    places = f"filter(transform(words, (w, i) -> if(array_contains({every}, w), i, -1)), i -> i >= 0)"
    ranks = f"filter(transform(words, (w, i) -> named_struct('i', i, 'r', array_position({rare}, w))), x -> x.r > 0)"
    # the places are bound once, as the element of an array
    bound = f"if(size(words) >= {need} AND arrays_overlap(words, {prefix}), array(named_struct('p', {places}, 'h', {ranks})), cast(array() as array<struct<p:array<int>,h:array<struct<i:int,r:bigint>>>>))"
    held = f"size(array_distinct(transform(filter(s.h, x -> x.i >= b AND x.i < b + {2 * n}), x -> x.r))) >= {len(looked) - spare}"
    able = f"flatten(transform({bound}, s -> filter(s.p, b -> size(words) - b >= {need} AND {held})))"
    found = f"transform({able}, b -> size(array_intersect({every}, slice(words, int(b + 1), {2 * n}))))"
    return f"transform(filter({found}, m -> m >= {need}), m -> m / {n}D)"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row."""
    sets = [(list(dict.fromkeys(t.split())), label) for t, label in TEMPLATES]
    frequency = token_frequency(docs, sorted({w for words, _ in sets for w in words}), text_col)
    ordered = [(sorted(words, key=lambda w: (frequency.get(w, 0), w)), label) for words, label in sets]
    prefixes = sorted({w for words, _ in ordered for w in words[: len(words) - needed_tokens(len(words)) + 1]})
    rare_of_phrases = sorted({min(p.split(), key=lambda w: (frequency.get(w, 0), w)) for p, _ in PHRASES})

    rows = docs.select(F.col(id_col).alias("doc_id"), normalized(F.col(text_col)).alias("norm"))
    rows = rows.withColumns({
        "n_words": F.when(F.col("norm") == "", 0).otherwise(F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit(""))) + 1).cast("long"),
        "words": F.split("norm", " "),
    }).drop("norm")
    probe = F.expr(f"arrays_overlap(words, {_sql_array(sorted({*prefixes, *rare_of_phrases}))})")
    rows = rows.withColumn("words", F.when(probe, F.col("words")).otherwise(F.expr("cast(array() as array<string>)")))
    places = {f"p{k}": F.expr(_places(phrase)) for k, (phrase, _) in enumerate(PHRASES)}
    scores = {f"s{k}": F.expr(_matching_scores(words)) for k, (words, _) in enumerate(ordered)}
    rows = rows.withColumns(places | scores)
    starts = F.concat(*places)
    base = F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)])
    own = F.array(*[F.when(F.size(f"s{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(ordered)])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(F.array_compact(labels))), ",")
    best = F.coalesce(F.array_max(F.concat(*scores)), F.lit(0.0))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        F.when(F.size(starts) > 0, 1.0).otherwise(best).alias("score"),
    )


def _duckdb_sql() -> str:
    templates = ", ".join(
        f"({k}, '{label}', {list(dict.fromkeys(text.split()))}, {len(set(text.split()))}, {needed_tokens(len(set(text.split())))})" for k, (text, label) in enumerate(TEMPLATES)
    )
    phrases = ", ".join(f"('{text}', '{label}', {len(text.split())})" for text, label in PHRASES)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS words
  FROM documents
), t(k, label, tokens, n, need) AS (VALUES {templates}), p(phrase, label, n) AS (VALUES {phrases}),
places AS (
  SELECT r, label, i FROM (SELECT r, words, unnest(range(len(words))) AS i FROM d), p
  WHERE array_to_string(words[i + 1 : i + n], ' ') = phrase
), base AS (
  SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM places GROUP BY r
), able AS (
  SELECT r, words, label, n, need, tokens FROM d, t WHERE len(list_intersect(tokens, words)) >= need
), blocks AS (
  SELECT r, label, n, need, len(list_intersect(tokens, words[b + 1 : b + 2 * n])) AS m
  FROM (SELECT *, unnest(range(len(words))) AS b FROM able)
), own AS (
  SELECT r, label, max(m / n) AS score FROM blocks WHERE m >= need GROUP BY r, label
), every AS (
  SELECT r, label, true AS is_base FROM places UNION SELECT r, label, false FROM own
), named AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM every GROUP BY r
), best AS (SELECT r, max(score) AS score FROM own GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN named USING (r) LEFT JOIN best USING (r)
"""


SQL = _duckdb_sql()
