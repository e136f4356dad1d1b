"""Operator 1: licence scans by sentence rules.

Texts that have a cue are cut into sentences, which may be wrapped over lines and comments. A normalised sentence is mapped to the identifier of the
first known licence sentence it matches, and the sequence of a document's identifiers is matched,
leftmost first and in the order of the rules, against licence rules, each of which is a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Cues, known sentences in order, and rules in order. Patterns meet lower-case text in which
# every other sign than letters, digits, '.', '+' and '-' is one blank; they read the same in Java and RE2.
CUE = "(?i)licen[sc]e|copyright|rights reserved|permission is hereby|public domain|spdx|redistribution|warrant|creative commons|cc by|cc0"
SENTENCES = [
    ("SPDX-APACHE2", r"spdx-license-identifier apache-2\.0"),
    ("SPDX-MIT", r"spdx-license-identifier mit"),
    ("SPDX-GPL3", r"spdx-license-identifier gpl-3\.0"),
    ("SPDX-GPL2", r"spdx-license-identifier gpl-2\.0"),
    ("SPDX-BSD3", r"spdx-license-identifier bsd-3-clause"),
    ("APACHE2", r"licensed under (the )?apache license,? ?(version )?2\.0"),
    ("APACHE-COPY", r"you may obtain a copy of the license"),
    ("APACHE-NOTICE", r"you may not use this (file|work) except in compliance with the license"),
    ("ASIS-LICENSE", r"distributed under the license is distributed on an as is basis"),
    ("LGPL3", r"gnu lesser general public license,? ?(version |v)3"),
    ("LGPL21", r"gnu lesser general public license,? ?(version |v)2\.1"),
    ("AGPL3", r"gnu affero general public license,? ?(version |v)3"),
    ("GPL3+", r"gnu general public license.*(version |v)3.*or (at your option )?any later version"),
    ("GPL3", r"gnu general public license,? ?(version |v)3"),
    ("GPL2+", r"gnu general public license.*(version |v)2.*or (at your option )?any later version"),
    ("GPL2", r"gnu general public license,? ?(version |v)2"),
    ("GPL", r"gnu general public license"),
    ("MIT-GRANT", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("MIT-NOTICE", r"above copyright notice and this permission notice shall be included"),
    ("MIT-NAME", r"(released|licensed|distributed|available) under (the terms of )?(the )?mit license"),
    ("BSD-SOURCE", r"redistributions of source code must retain the above copyright"),
    ("BSD-BINARY", r"redistributions in binary form must reproduce the above copyright"),
    ("BSD-NOENDORSE", r"neither the name of .* may be used to endorse or promote"),
    ("BSD-HEAD", r"redistribution and use in source and binary forms"),
    ("BSD-NAME", r"(released|licensed|distributed) under (the )?(new |simplified |3-clause |2-clause )?bsd license"),
    ("MPL2", r"mozilla public license,? ?(v\. |version |v)?2\.0"),
    ("CC0", r"\bcc0\b|creative commons zero"),
    ("CC-BY-NC-SA-4", r"cc.by-nc-sa 4\.0|attribution-noncommercial-sharealike 4\.0"),
    ("CC-BY-NC-ND-4", r"cc.by-nc-nd 4\.0|attribution-noncommercial-noderivatives 4\.0"),
    ("CC-BY-NC-4", r"cc.by-nc 4\.0|attribution-noncommercial 4\.0"),
    ("CC-BY-SA-4", r"cc.by-sa 4\.0|attribution-sharealike 4\.0"),
    ("CC-BY-4", r"cc.by 4\.0|creative commons attribution 4\.0"),
    ("PUBLIC-DOMAIN", r"(released|dedicated|placed|is) (in|into|to) the public domain"),
    ("RIGHTS", r"all rights reserved"),
    ("NO-WARRANTY", r"provided as is.*without warranty|without any warranty"),
    ("COPYRIGHT", r"^copyright( c)? [0-9]{4}"),
]
RULES = [
    ("MIT", ["MIT-GRANT", "MIT-NOTICE", "NO-WARRANTY"]),
    ("MIT", ["MIT-GRANT", "MIT-NOTICE"]),
    ("BSD-3-Clause", ["BSD-HEAD", "BSD-SOURCE", "BSD-BINARY", "BSD-NOENDORSE"]),
    ("BSD-3-Clause", ["BSD-SOURCE", "BSD-BINARY", "BSD-NOENDORSE"]),
    ("BSD-2-Clause", ["BSD-HEAD", "BSD-SOURCE", "BSD-BINARY"]),
    ("BSD-2-Clause", ["BSD-SOURCE", "BSD-BINARY"]),
    ("Apache-2.0", ["APACHE2", "APACHE-NOTICE", "APACHE-COPY", "ASIS-LICENSE"]),
    ("Apache-2.0", ["APACHE2"]),
    ("Apache-2.0", ["SPDX-APACHE2"]),
    ("MIT", ["SPDX-MIT"]),
    ("GPL-3.0-only", ["SPDX-GPL3"]),
    ("GPL-2.0-only", ["SPDX-GPL2"]),
    ("BSD-3-Clause", ["SPDX-BSD3"]),
    ("LGPL-3.0", ["LGPL3"]),
    ("LGPL-2.1", ["LGPL21"]),
    ("AGPL-3.0", ["AGPL3"]),
    ("GPL-3.0-or-later", ["GPL3+", "NO-WARRANTY"]),
    ("GPL-3.0-or-later", ["GPL3+"]),
    ("GPL-3.0-only", ["GPL3"]),
    ("GPL-2.0-or-later", ["GPL2+"]),
    ("GPL-2.0-only", ["GPL2"]),
    ("GPL", ["GPL"]),
    ("MIT", ["MIT-NAME"]),
    ("BSD", ["BSD-NAME"]),
    ("MPL-2.0", ["MPL2"]),
    ("CC0-1.0", ["CC0"]),
    ("CC-BY-NC-SA-4.0", ["CC-BY-NC-SA-4"]),
    ("CC-BY-NC-ND-4.0", ["CC-BY-NC-ND-4"]),
    ("CC-BY-NC-4.0", ["CC-BY-NC-4"]),
    ("CC-BY-SA-4.0", ["CC-BY-SA-4"]),
    ("CC-BY-4.0", ["CC-BY-4"]),
    ("Public-Domain", ["PUBLIC-DOMAIN"]),
    ("All-Rights-Reserved", ["COPYRIGHT", "RIGHTS"]),
    ("All-Rights-Reserved", ["RIGHTS"]),
]
CC_NAMES = [
    ("by-nc-sa", "attribution-noncommercial-sharealike"), ("by-nc-nd", "attribution-noncommercial-noderivs"), ("by-nc", "attribution-noncommercial"),
    ("by-nd", "attribution-noderivs"), ("by-sa", "attribution-sharealike"), ("by", "attribution"),
]
# What the SQL, which looks at single lines only, leaves out: cues that every known sentence has one of, comment
# leaders, and the sentences and rules of the standard headers.
ANY_CUE = r"(?i)licen[sc]e|copyright|reserved|permission|domain|spdx|redistribution|warrant|creative|cc[^a-z0-9]*by|cc.by|cc0|attribution|gnu|endorse"
LEADER = r"(?m)^[ \t]*(?:[#*/;%!-]+(?=\s|$))?[ \t]*"
HEADER_SENTENCES = [
    ("LGPL3+", r"gnu lesser general public license.*(version |v)3.*or (at your option )?any later version"),
    ("LGPL21+", r"gnu lesser general public license.*(version |v)2\.1.*or (at your option )?any later version"),
    ("LGPL2", r"gnu library general public license"),
    ("AGPL3+", r"gnu affero general public license.*(version |v)3.*or (at your option )?any later version"),
    ("GFDL", r"gnu free documentation license"),
    ("ISC-GRANT", r"permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC-NAME", r"under (the )?isc license"),
    ("ZLIB-GRANT", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("ZLIB-NAME", r"under (the )?zlib license"),
    ("BSL1", r"boost software license( -)? ?(version |v)?1\.0|permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("EPL2", r"eclipse public license( -)? ?(version |v\. ?|v ?)?2\.0"),
    ("EPL1", r"eclipse public license( -)? ?(version |v\. ?|v ?)?1\.0"),
    ("MPL11", r"mozilla public license,? ?(v\. |version |v)?1\.1"),
    ("CDDL", r"common development and distribution license"),
    ("ARTISTIC2", r"artistic license,? ?(version |v)?2\.0"),
    ("EUPL12", r"european union public licen[cs]e( -)? ?(version |v\. ?|v ?)?1\.2"),
    ("OFL11", r"sil open font license,? ?(version |v)?1\.1"),
    ("AFL3", r"academic free license,? ?(version |v\. ?|v)?3\.0"),
    ("MSPL", r"microsoft public license"),
    ("MSRL", r"microsoft reciprocal license"),
    ("PSF", r"(psf|python software foundation) license"),
    ("POSTGRESQL", r"under (the )?postgresql license"),
    ("UNLICENSE", r"this is free and unencumbered software released into the public domain"),
    ("WTFPL", r"do what the f[a-z]+ you want to public license"),
    ("APACHE11", r"licensed under (the )?apache( software)? license,? ?(version )?1\.1"),
    *((f"CC-{t.upper()}-{v}", rf"cc.{t} {v[0]}\.{v[1]}|creative commons {n} {v[0]}\.{v[1]}") for v in ("30", "25", "20") for t, n in CC_NAMES),
]
# Identifiers that expressions name, in their published spelling.
SPDX_IDS = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-4-Clause BSL-1.0 "
    "CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 "
    "GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-or-later GPL-2.0 GPL-2.0+ GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0+ GPL-3.0-only GPL-3.0-or-later ISC "
    "LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1+ LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0+ LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL "
    "NCSA OFL-1.1 OpenSSL PostgreSQL PSF-2.0 Python-2.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1"
).split()
TERM = r"[a-z0-9.+-]*[a-z0-9+](?: with [a-z0-9.+-]*[a-z0-9+])?"
EXPRESSION = rf"spdx-license-identifier ({TERM}(?: (?:or|and) {TERM})*)"
# Expressions that known sentences read already, and sentences that deny a licence.
KNOWN_TERMS = ("apache-2.0", "mit", "gpl-3.0", "gpl-3.0-only", "gpl-2.0", "gpl-2.0-only", "bsd-3-clause")
NEGATED = r"\b(not|never|no longer|isn t|aren t|wasn t) (yet |be |been |being )?(re)?(licensed|released|distributed|available|covered|published)\b.*\bunder\b"
HEADER_RULES = [
    *((licence, [i, "NO-WARRANTY", *["GPL"] * n]) for n in (2, 1) for licence, i in (("GPL-3.0-or-later", "GPL3+"), ("GPL-2.0-or-later", "GPL2+"))),
    ("LGPL-3.0-or-later", ["LGPL3+"]),
    ("LGPL-2.1-or-later", ["LGPL21+"]),
    ("AGPL-3.0-or-later", ["AGPL3+"]),
    *((licence, [i]) for licence, i in (
        ("LGPL-2.0", "LGPL2"), ("GFDL", "GFDL"), ("ISC", "ISC-GRANT"), ("ISC", "ISC-NAME"), ("Zlib", "ZLIB-GRANT"), ("Zlib", "ZLIB-NAME"), ("BSL-1.0", "BSL1"), ("EPL-2.0", "EPL2"), ("EPL-1.0", "EPL1"),
        ("MPL-1.1", "MPL11"), ("CDDL", "CDDL"), ("Artistic-2.0", "ARTISTIC2"), ("EUPL-1.2", "EUPL12"), ("OFL-1.1", "OFL11"), ("AFL-3.0", "AFL3"), ("MS-PL", "MSPL"), ("MS-RL", "MSRL"), ("PSF-2.0", "PSF"),
        ("PostgreSQL", "POSTGRESQL"), ("Unlicense", "UNLICENSE"), ("WTFPL", "WTFPL"), ("Apache-1.1", "APACHE11"),
        *((f"CC-{t.upper()}-{v[0]}.{v[1]}", f"CC-{t.upper()}-{v}") for v in ("30", "25", "20") for t, _ in CC_NAMES),
    )),
]
BREAK, SIGNS = r"([.!?])\s+", r"[^a-z0-9.+-]+"


def _rule_text(ids: list[str]) -> str:
    return "".join(f"<{i}>" for i in ids)


def _rule_pattern(rules: list = RULES) -> str:
    return "(" + "|".join(_rule_text(ids).replace("+", r"\+").replace(".", r"\.") for _, ids in rules) + ")"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id, sentence_ids, licenses, n_sentences`` of documents with a known licence sentence.

    Whole texts; a row per row of the input with a hit. ``sentence_ids`` is the sequence in order, each in
    angle brackets; ``licenses`` the distinct licences of the matched rules, sorted and joined by ', '. The
    terms of an SPDX expression are licences each, with OR as with AND. A sentence that denies a licence has none.
    Null and empty texts have none; null ids and repeated rows pass; other columns are ignored. All in
    one projection without a shuffle: sentences stay in their row, and only texts with a cue are cut.
    """
    # An expression becomes one identifier a term, all of one sentence; a term is a rule by itself.
    terms = f"transform(regexp_extract_all(regexp_extract(s, r'{EXPRESSION}', 1), r'(?:^|(?:or|and) )({TERM})', 1), t -> concat('<SPDX:', t, '>'))"
    known_terms = ", ".join(f"'{t}'" for t in KNOWN_TERMS)
    case = f"when rlike(s, r'{NEGATED}') then null when rlike(s, r'{EXPRESSION}') and regexp_extract(s, r'{EXPRESSION}', 1) not in ({known_terms}) then array_join({terms}, '') "
    case += " ".join(f"when rlike(s, r'{p}') then '<{i}>'" for i, p in HEADER_SENTENCES + SENTENCES)
    rules = HEADER_RULES + RULES
    name = " ".join(f"when '{_rule_text(ids)}' then '{licence}'" for licence, ids in rules)
    spelled = " ".join(f"when '{i.lower()}' then '{i}'" for i in SPDX_IDS)
    named = f"if(startswith(r, '<SPDX:'), concat(case regexp_extract(r, ':([^ >]+)', 1) {spelled} else regexp_extract(r, ':([^ >]+)', 1) end, replace(regexp_extract(r, '( with [^>]+)>', 1), ' with ', ' WITH ')), case r {name} end)"
    cued = docs.select("doc_id", "text").where(F.col("text").rlike(ANY_CUE))
    lines = F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), LEADER, "")
    cut = F.regexp_replace(F.regexp_replace(lines, BREAK, "$1\u0001"), r"\n\n+", "\u0001")
    cued = cued.select("doc_id", F.split(cut, "\u0001").alias("parts"))
    cued = cued.select("doc_id", F.expr(f"filter(parts, s -> rlike(s, r'{ANY_CUE}'))").alias("parts"))
    plain = lambda s: f"trim(regexp_replace(lower({s}), r'{SIGNS}', ' '))"
    known = lambda parts: f"filter(transform(transform({parts}, s -> {plain('s')}), s -> case {case} end), s -> s is not null)"
    both = cued.select("doc_id", F.expr(f"transform(parts, part -> named_struct('lines', {known('split(part, chr(10))')}, 'whole', if(contains(part, chr(10)), {known('array(part)')}, array())))").alias("both"))
    # a wrapped sentence takes the place of the less exact ones that its lines make: GPL3+ that of GPL
    inexact = "exists(b.whole, w -> startswith(w, substring(i, 1, length(i) - 1)))"
    merged = f"if(size(array_except(b.whole, b.lines)) = 0, b.lines, concat(filter(b.lines, i -> not {inexact}), b.whole))"
    ids = both.select("doc_id", F.expr(f"flatten(transform(both, b -> {merged}))").alias("ids")).where(F.size("ids") > 0)
    ids = ids.select("doc_id", F.array_join("ids", "").alias("sentence_ids"), F.size("ids").cast("bigint").alias("n_sentences"))
    found = F.expr(f"transform(regexp_extract_all(sentence_ids, r'(<SPDX:[^>]+>|{_rule_pattern(rules)[1:]}', 1), r -> {named})")
    return ids.select("doc_id", "sentence_ids", F.array_join(F.array_sort(F.array_distinct(found)), ", ").alias("licenses"), "n_sentences")


def oracle() -> str:
    case = " ".join(f"when regexp_matches(s, '{p}') then '<{i}>'" for i, p in SENTENCES)
    name = " ".join(f"when '{_rule_text(ids)}' then '{licence}'" for licence, ids in RULES)
    return f"""
    with parts as (
      select doc_id, list_filter(string_split(regexp_replace(text, '{BREAK}', '\\1' || chr(10), 'g'), chr(10)),
        lambda s: regexp_matches(s, '{CUE}') or regexp_matches(s, '(?i)you may|neither the name|as is')) as parts
      from documents where regexp_matches(text, '{CUE}')),
    plain as (select doc_id, list_transform(parts, lambda s: trim(regexp_replace(lower(s), '{SIGNS}', ' ', 'g'))) as parts from parts),
    ids as (select doc_id, list_filter(list_transform(parts, lambda s: case {case} end), lambda s: s is not null) as ids from plain),
    joined as (select doc_id, array_to_string(ids, '') as sentence_ids, len(ids) as n_sentences from ids where len(ids) > 0)
    select doc_id, sentence_ids, n_sentences,
      array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(sentence_ids, '{_rule_pattern()}', 1),
        lambda r: case r {name} end))), ', ') as licenses
    from joined"""
