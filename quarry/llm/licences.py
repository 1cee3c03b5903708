"""Licence recognition by sentence rules (DataFrame functions only).

A text is split into sentences, each is normalised (lower case, letters and digits, single spaces) and looked up among known licence
sentences, which have identifiers; of "Version 2.0" and the like the identifier takes the number. The identifiers of a text, in order,
are then matched against ordered licence rules; what a rule matches is taken out before the next one looks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences, normalised, as whole-sentence patterns, and their identifiers. The first that fits names it.
SENTENCES = [
    ("SPDX:$1", "spdx license identifier ([a-z0-9 ]+?)"),
    ("ApacheLic:$1", "(?:licensed|released|distributed|available) under (?:the terms of )?the apache (?:software )?license version ([0-9.]+)(?: the license)?"),
    ("ApacheUse", "you may not use this file except in compliance with the license"),
    ("ApacheCopy", "you may obtain a copy of the license at(?: http[a-z0-9 ]*)?"),
    ("ApacheWarranty", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("ApacheSee", "see the license for the specific language governing permissions and limitations under the license"),
    ("MITLic", "(?:licensed|released|distributed|available) under (?:the terms of )?the (?:mit|expat) licen[cs]e"),
    ("MITPermission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files .*"),
    ("MITNotice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MITWarranty", "the software is provided as is without warranty of any kind.*"),
    ("GPLVer:$1:$2", "(?:licensed|released|distributed|available) under (?:the terms of )?the gnu (lesser general|affero general|general) public licen[cs]e version ([0-9.]+)"),
    ("GPLVerPlus:$1:$2", "(?:licensed|released|distributed|available) under (?:the terms of )?the gnu (lesser general|affero general|general) public licen[cs]e version ([0-9.]+) or (?:at your option )?any later version"),
    ("GPLFree:$1:$2:$3", "(?:this program|this library|it) is free software you can redistribute it and or modify it under the terms of the gnu (lesser general|affero general|general) public licen[cs]e as published by the free software foundation either version ([0-9.]+) of the licen[cs]e( or at your option any later version)?"),
    ("GPLNoWarranty", "this (?:program|library) is distributed in the hope that it will be useful but without any warranty.*"),
    ("GPLCopy", "you should have received a copy of the gnu .* licen[cs]e along with this (?:program|library).*"),
    ("CC:$1:$2", "(?:licensed|released|distributed|available) under (?:the terms of )?(?:a |the )?(?:creative commons|cc) ([a-z ]+?) ([0-9.]+)(?: (?:international|unported))?(?: licen[cs]e)?"),
    ("CC0", "(?:licensed|released|distributed|available|dedicated) (?:to the public domain )?(?:under )?(?:the terms of )?(?:the )?cc0(?: 1\\.0)?(?: universal)?(?: licen[cs]e)?"),
    ("BSDLic:$1", "(?:licensed|released|distributed|available) under (?:the terms of )?the (?:bsd )?([234]) clause (?:bsd )?licen[cs]e"),
    ("BSDRedist", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met.*"),
    ("BSDSource", "(?:[0-9a] )?redistributions of source code must retain the above copyright notice.*"),
    ("BSDBinary", "(?:[0-9b] )?redistributions in binary form must reproduce the above copyright notice.*"),
    ("BSDEndorse", "(?:[0-9c] )?neither the name of .* may be used to endorse or promote products derived from this software.*"),
    ("BSDWarranty", "this software is provided by .* as is and any express or implied warranties.*"),
    ("MPLLic:$1", "(?:this source code form is subject to the terms of|(?:licensed|released|distributed|available) under (?:the terms of )?)(?: )?the mozilla public licen[cs]e (?:v |version )?([0-9.]+)"),
    ("ISCLic", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted.*"),
    ("BoostLic:$1", "distributed under the boost software license version ([0-9.]+)"),
    ("MITLic", "(?:licensed|released|distributed|available) under (?:the terms of )?the (?:mit|expat) licen[cs]e see .*"),
    ("ApacheTitle:$1", "apache license version ([0-9.]+) january 2004.*"),
    ("GPLTitle:$1:$2", "gnu (lesser general|library general|affero general|general) public licen[cs]e version ([0-9.]+)(?: [0-9]+)? [a-z]+ [0-9]+"),
    ("GPLOnly:$1:$2", "(?:this program|this library|it) is free software you can redistribute it and or modify it under the terms of the gnu (lesser general|affero general|general) public licen[cs]e version ([0-9.]+) (?:only )?as published by the free software foundation"),
    ("GPLOnly:$1:$2", "(?:this program|this library|it) is free software you can redistribute it and or modify it under the terms of the gnu (lesser general|affero general|general) public licen[cs]e as published by the free software foundation version ([0-9.]+) of the licen[cs]e(?: only)?"),
    ("MPLTitle:$1", "mozilla public licen[cs]e version ([0-9.]+)"),
    ("EPLLic:$1", "(?:this program and the accompanying materials are made available|licensed|released|distributed|available) under (?:the terms of )?the eclipse public licen[cs]e (?:v |v|version )?([0-9.]+)(?: which .*)?"),
    ("EPLTitle:$1", "eclipse public licen[cs]e (?:v |version )([0-9.]+)"),
    ("CDDLLic", "the contents of this file are subject to the terms of (?:either )?the common development and distribution licen[cs]e.*"),
    ("CDDLTitle:$1", "common development and distribution licen[cs]e cddl version ([0-9.]+)"),
    ("ZlibWarranty", "this software is provided as is without any express or implied warranty"),
    ("ZlibLiable", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("ZlibPermission", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions.*"),
    ("ArtisticLic:$1", "(?:licensed|released|distributed|available) under (?:the terms of )?the artistic licen[cs]e (?:v |version )?([0-9.]+)"),
    ("ArtisticTitle:$1", "the artistic licen[cs]e ([0-9.]+)(?: copyright .*)?"),
    ("PerlTerms", "(?:this program|this library|this module|it) is free software you can redistribute it and or modify it under the same terms as perl itself"),
    ("WTFPLTitle", "do what the fuck you want to public licen[cs]e version 2.*"),
    ("WTFPLLic", "(?:licensed|released|distributed|available) under (?:the terms of )?the (?:wtfpl|do what the fuck you want to public licen[cs]e).*"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("PublicDomain", "(?:released|placed) (?:into|in) the public domain"),
    ("AllRights", "all rights reserved"),
    ("LicenceOther", "(?:licensed|released|distributed) under .*licen[cs]e.*"),
]

#: Rules in order. A rule is a pattern on the identifiers (each in its own line) and the licence it means.
RULES = [
    ("SPDX-$1", "SPDX:([^\\n]+)\\n"),
    ("Apache-$1", "ApacheLic:([^\\n]+)\\n(?:ApacheUse\\n)?(?:ApacheCopy\\n)?(?:ApacheWarranty\\n)?(?:ApacheSee\\n)?"),
    ("AGPL-$1-or-later", "GPLFree:affero general:([^:\\n]+): or[^\\n]*\\n(?:GPLNoWarranty\\n)?(?:GPLCopy\\n)?"),
    ("LGPL-$1-or-later", "GPLFree:lesser general:([^:\\n]+): or[^\\n]*\\n(?:GPLNoWarranty\\n)?(?:GPLCopy\\n)?"),
    ("GPL-$1-or-later", "GPLFree:general:([^:\\n]+): or[^\\n]*\\n(?:GPLNoWarranty\\n)?(?:GPLCopy\\n)?"),
    ("AGPL-$1-only", "GPL(?:Free|Ver):affero general:([^:\\n]+):?\\n(?:GPLNoWarranty\\n)?(?:GPLCopy\\n)?"),
    ("LGPL-$1-only", "GPL(?:Free|Ver):lesser general:([^:\\n]+):?\\n(?:GPLNoWarranty\\n)?(?:GPLCopy\\n)?"),
    ("GPL-$1-only", "GPL(?:Free|Ver):general:([^:\\n]+):?\\n(?:GPLNoWarranty\\n)?(?:GPLCopy\\n)?"),
    ("AGPL-$1-or-later", "GPLVerPlus:affero general:([^:\\n]+)\\n"),
    ("LGPL-$1-or-later", "GPLVerPlus:lesser general:([^:\\n]+)\\n"),
    ("GPL-$1-or-later", "GPLVerPlus:general:([^:\\n]+)\\n"),
    ("AGPL-$1-only", "GPLOnly:affero general:([^\\n]+)\\n(?:GPLNoWarranty\\n)?(?:GPLCopy\\n)?"),
    ("LGPL-$1-only", "GPLOnly:lesser general:([^\\n]+)\\n(?:GPLNoWarranty\\n)?(?:GPLCopy\\n)?"),
    ("GPL-$1-only", "GPLOnly:general:([^\\n]+)\\n(?:GPLNoWarranty\\n)?(?:GPLCopy\\n)?"),
    ("Apache-$1", "ApacheTitle:([^\\n]+)\\n"),
    ("AGPL-$1", "GPLTitle:affero general:([^\\n]+)\\n"),
    ("LGPL-$1", "GPLTitle:(?:lesser|library) general:([^\\n]+)\\n"),
    ("GPL-$1", "GPLTitle:general:([^\\n]+)\\n"),
    ("EPL-$1", "EPL(?:Lic|Title):([^\\n]+)\\n"),
    ("CDDL-$1", "CDDLTitle:([^\\n]+)\\n"),
    ("CDDL", "CDDLLic\\n(?:ApacheUse\\n)?"),
    ("Zlib", "(?:ZlibWarranty\\n)?(?:ZlibLiable\\n)?ZlibPermission\\n"),
    ("Artistic-$1", "Artistic(?:Lic|Title):([^\\n]+)\\n"),
    ("Artistic-1.0-Perl OR GPL-1.0-or-later", "PerlTerms\\n"),
    ("WTFPL", "WTFPL(?:Lic|Title)\\n"),
    ("BSD-3-Clause", "BSDRedist\\nBSDSource\\nBSDBinary\\nBSDEndorse\\n(?:BSDWarranty\\n)?"),
    ("BSD-2-Clause", "BSDRedist\\nBSDSource\\nBSDBinary\\n(?:BSDWarranty\\n)?"),
    ("BSD-$1-Clause", "BSDLic:([^\\n]+)\\n"),
    ("MIT", "MITLic\\n|MITPermission\\n(?:MITNotice\\n)?(?:MITWarranty\\n)?"),
    ("MPL-$1", "MPL(?:Lic|Title):([^\\n]+)\\n"),
    ("CC-$1-$2", "CC:([^:\\n]+):([^\\n]+)\\n"),
    ("CC0-1.0", "CC0\\n"),
    ("ISC", "ISCLic\\n(?:MITWarranty\\n)?"),
    ("BSL-$1", "BoostLic:([^\\n]+)\\n"),
    ("Unlicense", "Unlicense\\n"),
    ("PublicDomain", "PublicDomain\\n"),
    ("Proprietary", "AllRights\\n"),
    ("Unknown", "(?:LicenceOther|[A-Z][A-Za-z]+(?::[^\\n]*)?)\\n"),
]

#: A sentence without any of these can be none of the above.
HINT = "licen[cs]|perl itself|held liable|permission|warrant|redistribut|copyright|public domain|rights reserved|free software|neither the name|copy of the gnu|cc0|creative commons"
END = "[!?]+|\\.(?:[\\x20\\x09-\\x0D]+|$)|\\n[\\x20\\x09-\\x0D#*/]*\\n"
JUNK = "[^a-z0-9.]+|\\.(?:[^a-z0-9]+|$)"

#: What standard notices need beyond the tables above, from which the SQL is made: the SQL is fixed, so it doesn't have these. In lower case,
#: an SPDX line ends a sentence, "2.0+" is "2.0-or-later", "license v. 2" is "license version 2", and ; ends a sentence before
#: "you may" or a line break, unless a GPL notice goes on there.
STEPS = [
    ("(spdx-license-identifier:[^\\n+]*[0-9])\\+", "$1-or-later"),
    ("(spdx-license-identifier:[^\\n]*)\\n", "$1\n\n"),
    ("(licen[cs]e,?[^a-z0-9]+)v\\.?[\\x20\\x09]*(?=[0-9])", "$1version "),
    (";(?=[^a-z0-9]*you\\s+may\\s)|;(?=[\\x20\\x09\\r]*\\n(?![^a-z0-9]*(?:you\\s+can|either|version|or)\\b))", "\n\n"),
]
WIDER = {"SPDX:$1": "spdx license identifier ([a-z0-9. ]+?)", "ApacheCopy": "you may obtain a copy of the license at(?: http[a-z0-9. ]*)?"}
KNOWN = [(name, WIDER.get(name, pattern)) for name, pattern in SENTENCES]
#: Words of a hint may be apart by a line break and comment marks.
HINTS = HINT.replace(" ", "[^a-z0-9]+") + "|cc[^a-z0-9]+by"


def whole(pattern: str) -> str:
    """A pattern for a whole sentence; words may stand before the known ones, as a heading does that ends without a dot.

    At most one part of a pattern matches any words: where two might, in the last entry, the first one ends for good at the first place that fits,
    as a later place would leave less to find. So a sentence of any length takes time in proportion to it.
    """
    if pattern.count(".*") == 2:
        before, between, after = pattern.split(".*")
        return f"^(?>(?:.*? )??{before}).*{between}{after}"
    return f"^(?:.* )?(?:{pattern})$"


def whole_sql(pattern: str) -> str:
    """The same for engines without patterns that end for good; they take linear time anyway."""
    return f"^(?:.* )?(?:{pattern})$"


def sentences(text: Column) -> Column:
    """The normalised sentences that may be licence sentences. They end at a dot before white space, at ! and ?, and at blank lines, and as STEPS says."""
    low = F.lower(text)
    for pattern, by in STEPS:
        low = F.regexp_replace(low, pattern, by)
    parts = F.filter(F.split(low, END), lambda s: s.rlike(HINTS))
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, JUNK, " "))), lambda s: s != "")


def identifier(sentence: Column) -> Column:
    """The identifier of a normalised sentence, null if unknown."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(KNOWN):
        out = F.when(sentence.rlike(whole(pattern)), F.regexp_replace(sentence, whole(pattern), name) if "$" in name else F.lit(name)).otherwise(out)
    return out


def _namer(pattern: str, licence: str):
    """From what a rule matched to the licence's name."""

    def named(hit: Column) -> Column:
        if "$" not in licence:
            return F.lit(licence)
        name = F.replace(F.regexp_replace(hit, pattern, licence), F.lit(" "), F.lit("-"))
        return F.upper(name) if licence.startswith(("CC-", "SPDX-")) else name

    return named


def licences(docs: DataFrame) -> DataFrame:
    """Of each text: doc_id, n_sentences (known licence sentences, long), sentence_ids, licences (strings joined by commas; licences in
    the order of the rules, then by place, each once).

    Null and empty texts, and those without a licence sentence, have 0 and empty strings. Rows that repeat a doc_id are each
    answered; other columns are ignored; an empty table gives an empty result. A very long text is one row like any other.
    """
    low = F.coalesce(F.col("text"), F.lit(""))
    found = F.when(F.lower(low).rlike(HINTS), F.filter(F.transform(sentences(low), identifier), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    step = docs.select("doc_id", found.alias("ids"))
    step = step.select("doc_id", "ids", F.concat(F.array_join("ids", "\n"), F.when(F.size("ids") > 0, "\n").otherwise("")).alias("rest"), F.array().cast("array<string>").alias("names"))
    for licence, pattern in RULES:
        hits = F.regexp_extract_all("rest", F.lit(pattern), F.lit(0))
        names = F.concat("names", F.transform(hits, _namer(pattern, licence)))
        step = step.select("doc_id", "ids", F.when(F.col("rest") == "", F.col("names")).otherwise(names).alias("names"), F.when(F.col("rest") == "", "").otherwise(F.regexp_replace("rest", pattern, "")).alias("rest"))
    return step.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(F.array_distinct("names"), ",").alias("licences"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The same for DuckDB, from the same tables of sentences and rules."""
    groups = lambda x: _quoted(x.replace("$", "\\"))
    cases = " ".join(f"WHEN regexp_matches(s, {_quoted(whole_sql(p))}) THEN " + (f"regexp_replace(s, {_quoted(whole_sql(p))}, {groups(n)})" if "$" in n else _quoted(n)) for n, p in SENTENCES)
    parts = f"list_filter(string_split_regex(lower(coalesce(text, '')), {_quoted(END)}), lambda s: regexp_matches(s, {_quoted(HINT)}))"
    clean = f"list_filter(list_transform({parts}, lambda s: trim(regexp_replace(s, {_quoted(JUNK)}, ' ', 'g'))), lambda s: s <> '')"
    ctes = [f"r0 AS (SELECT doc_id, ids, CASE WHEN len(ids) > 0 THEN array_to_string(ids, chr(10)) || chr(10) ELSE '' END AS rest, []::VARCHAR[] AS names FROM (SELECT doc_id, list_filter(list_transform({clean}, lambda s: CASE {cases} END), lambda s: s IS NOT NULL) AS ids FROM documents))"]
    for k, (licence, pattern) in enumerate(RULES):
        name = f"replace(regexp_replace(h, {_quoted(pattern)}, {groups(licence)}), ' ', '-')" if "$" in licence else _quoted(licence)
        name = f"upper({name})" if "$" in licence and licence.startswith(("CC-", "SPDX-")) else name
        ctes.append(f"r{k + 1} AS (SELECT doc_id, ids, regexp_replace(rest, {_quoted(pattern)}, '', 'g') AS rest, list_concat(names, list_transform(regexp_extract_all(rest, {_quoted(pattern)}), lambda h: {name})) AS names FROM r{k})")
    once = "list_filter(names, lambda x, i: list_position(names, x) = i)"
    return f"WITH {', '.join(ctes)} SELECT doc_id, len(ids)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sentence_ids, array_to_string({once}, ',') AS licences FROM r{len(RULES)}"
