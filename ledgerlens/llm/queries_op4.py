"""License scans of every document."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .licenses import CONTAINED, Template, _needed, block_words, rivals, scan

NAME = "op4_license_scan"

# The phrases of the task and the usual notices of licenses.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = [
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("lgpl", "licensed under the gnu lesser general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license"),
    Template("cc-by", "licensed under cc by 4 0"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-nd", "licensed under cc by nd 4 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"), TEMPLATES, PHRASES, ["doc_id"])


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PHRASES = ", ".join(f"({[*p.split()]}, '{label}')" for p, label in PHRASES.items())
_TEMPLATES = ", ".join(f"({i}, {sorted(t.tokens)}, '{t.label}', {_needed(t, CONTAINED)})" for i, t in enumerate(TEMPLATES))
_RIVALS = ", ".join(map(str, rivals(TEMPLATES)))
_LENGTH = block_words(TEMPLATES)
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
phrase AS (SELECT * FROM (VALUES {_PHRASES}) AS t(p, label)),
tpl AS (SELECT * FROM (VALUES {_TEMPLATES}) AS t(t, held, label, needs)),
rival AS (SELECT * FROM (VALUES {_RIVALS}) AS t(t, t2)),
base AS (
  SELECT r, pos, label FROM (SELECT r, w, p, label, unnest(range(1, len(w) - len(p) + 2)) AS pos FROM d, phrase WHERE len(w) >= len(p))
  WHERE w[pos] = p[1] AND w[pos:pos + len(p) - 1] = p
), b AS (SELECT r, count(*) AS n_base, min(pos) - 1 AS first_word, max(pos) - 1 AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r
), block AS (SELECT r, j, w[j * {_LENGTH} + 1:j * {_LENGTH} + {2 * _LENGTH}] AS own FROM (SELECT r, w, unnest(range(0, (len(w) - 1) // {_LENGTH} + 1)) AS j FROM d WHERE len(w) > 0)
), pair AS (SELECT r, j, list_distinct(list_transform(range(1, len(own)), lambda i: own[i] || ' ' || own[i + 1])) AS own FROM block
), every_met AS (SELECT r, j, t, label, len(list_intersect(own, held)) AS common, len(held) AS size FROM pair, tpl WHERE len(list_intersect(own, held)) >= needs
), met AS (SELECT * FROM every_met a WHERE NOT EXISTS (SELECT 1 FROM every_met b JOIN rival ON rival.t2 = b.t
    WHERE b.r = a.r AND b.j = a.j AND rival.t = a.t AND (b.common / b.size > a.common / a.size OR (b.common / b.size = a.common / a.size AND b.common > a.common)))
), best AS (SELECT r, max(common / size) AS best FROM met GROUP BY r
), every AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM met UNION SELECT r, label FROM base) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN best USING (r) LEFT JOIN every USING (r)
"""
