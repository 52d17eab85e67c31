"""Operator 7: license scans by ordered signature rules, with DataFrame functions only.

A rule is a regular expression over a text's words, gated by a keyword that is part of whatever it matches: only where
the text holds the keyword, inside of a word or not, is the expression tried, and only texts that hold one of the stems,
which are derived from the keywords, try any rule at all. Detections are intervals of words. Of
two detections one of which lies inside the other the containing one stays, or, for equal intervals, the one of higher
priority. The base phrases of the query's contract are rules that nothing suppresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, let, running

#: Fixed values of the query's contract.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Names of licenses: label, keyword, expression over words. Most specific first.
NAMES = (
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license(?: v(?:ersion)? ?3| version 3)?(?: 0)?"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl(?: ?v?3(?: 0)?)?(?: only| or later)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public license(?: v(?:ersion)?)? ?2(?: 1)?"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public license(?: v(?:ersion)?)? ?3(?: 0)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public license"),
    ("lgpl", "library", r"gnu library general public license"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?: ?v?[23](?: [01])?)?(?: only| or later)?"),
    ("gpl-2.0", "general", r"gnu general public license(?: v(?:ersion)?)? ?2(?: 0)?"),
    ("gpl-3.0", "general", r"gnu general public license(?: v(?:ersion)?)? ?3(?: 0)?"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl ?v?2(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl ?v?3(?: 0)?(?: only| or later)?"),
    ("gpl-1.0", "general", r"gnu general public license(?: v(?:ersion)?)? ?1(?: 0)?"),
    ("gfdl", "documentation", r"gnu free documentation license(?: version 1(?: [123])?)?"),
    ("apache-2.0", "apache", r"apache(?: software)? license(?: v(?:ersion)?)? ?2(?: 0)?"),
    ("apache-2.0", "apache", r"apache 2(?: 0)?"),
    ("apache-1.1", "apache", r"apache(?: software)? license(?: version)? 1 1"),
    ("apache", "apache", r"apache(?: software)? license"),
    ("mit", "mit license", r"(?:the )?mit license"),
    ("mit", "licensed under", r"licensed under (?:the )?mit"),
    ("mit-text", "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "isc license", r"isc license"),
    ("isc-text", "permission", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3 clause) bsd(?: license)?"),
    ("bsd-3-clause", "bsd", r"bsd 3 clause(?: license)?"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|2 clause) bsd(?: license)?"),
    ("bsd-2-clause", "bsd", r"bsd 2 clause(?: license)?"),
    ("bsd-4-clause", "bsd", r"(?:original|4 clause) bsd(?: license)?"),
    ("0bsd", "bsd", r"(?:zero clause )?0?bsd zero clause|0bsd"),
    ("bsd", "bsd", r"bsd license"),
    ("bsd-text", "redistribution", r"redistribution and use in source and binary forms"),
    ("mpl-2.0", "mozilla", r"mozilla public license(?: v(?:ersion)?)? ?2(?: 0)?"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: v(?:ersion)?)? ?1(?: [01])?"),
    ("mpl", "mozilla", r"mozilla public license"),
    ("epl-2.0", "eclipse", r"eclipse public license(?: v(?:ersion)?)? ?2(?: 0)?"),
    ("epl-1.0", "eclipse", r"eclipse public license(?: v(?:ersion)?)? ?1(?: 0)?"),
    ("epl", "eclipse", r"eclipse public license"),
    ("cddl", "cddl", r"cddl(?: ?1(?: [01])?)?"),
    ("cddl", "distribution", r"common development and distribution license"),
    ("eupl", "european", r"european union public licen[cs]e"),
    ("artistic-2.0", "artistic", r"artistic license(?: 2(?: 0)?)?"),
    ("zlib", "zlib", r"zlib(?: libpng)? license"),
    ("boost-1.0", "boost", r"boost software license(?: version)?(?: 1 0)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("python-2.0", "python", r"python software foundation license(?: version 2)?"),
    ("ofl-1.1", "font", r"(?:sil )?open font license(?: version)?(?: 1 1)?"),
    ("ms-pl", "microsoft", r"microsoft (?:public|reciprocal) license"),
    ("openssl", "openssl", r"openssl license"),
    ("php-3.0", "php", r"php license(?: version)?(?: 3(?: 0)?)?"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("ecl-2.0", "educational", r"educational community license(?: version)?(?: 2 0)?"),
    ("afl-3.0", "academic", r"academic free license(?: version)?(?: [123] [01])?"),
    ("odbl-1.0", "database", r"open database license(?: v?1 0)?"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("public-domain", "public", r"(?:released|dedicated|placed)(?: in| into| to)? the public domain|public domain dedication"),
    ("proprietary", "proprietary", r"proprietary (?:and confidential|license|software)"),
    ("confidential", "confidential", r"(?:strictly|company) confidential"),
    ("reserved", "reserved", r"(?:some|no) rights reserved"),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?"),
    ("copyright", "copyrighted", r"copyrighted (?:material|work)s?"),
)
#: Creative Commons: each combination of conditions, with and without a version, and spelt out.
CONDITIONS = (("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?"), ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"), ("by-nc", "by nc", "attribution non ?commercial"), ("by-nd", "by nd", "attribution no ?deriv(?:ative)?s?"), ("by-sa", "by sa", "attribution share ?alike"), ("by", "by", "attribution"))
VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: How a license is named in a file's header, and how one is granted.
TAGGED = ("mit", "isc", "0bsd", "bsd 2 clause", "bsd 3 clause", "apache 2 0", "gpl 2 0 only", "gpl 2 0 or later", "gpl 3 0 only", "gpl 3 0 or later", "lgpl 2 1 only", "lgpl 2 1 or later", "lgpl 3 0 only", "lgpl 3 0 or later", "agpl 3 0 only", "agpl 3 0 or later", "mpl 2 0", "epl 2 0", "unlicense", "cc0 1 0", "zlib", "bsl 1 0", "ofl 1 1", "artistic 2 0", "eupl 1 2", "cddl 1 0", "ms pl", "postgresql", "python 2 0", "wtfpl", "odbl 1 0", "proprietary")
GRANTS = ("licensed under", "released under", "distributed under", "available under", "published under", "made available under", "dual licensed under", "relicensed under", "covered by", "subject to", "governed by", "under the terms of")
GRANTED = r"mit|bsd|apache|gnu|a?gpl|lgpl|mozilla|eclipse|creative commons|cc|isc|zlib|artistic"
#: Sentences of license texts and notices: label, keyword, expression over words.
NOTICES = (
    ("mit-text", "substantial portions", r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("mit-text", "deal in the software", r"to deal in the software without restriction"),
    ("mit-text", "sublicense and or sell", r"use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit-warranty", "noninfringement", r"warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-warranty", "authors or copyright", r"in no event shall the authors or copyright holders be liable for any claim"),
    ("mit-0", "mit no attribution", r"mit no attribution"),
    ("bsd-text", "redistributions of source", r"redistributions of source code must retain the above copyright notice(?: this list of conditions and the following disclaimer)?"),
    ("bsd-text", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "nor the names of", r"neither the name of (?:[^ ]+ ){1,8}nor the names of (?:its|their) contributors"),
    ("bsd-3-clause", "endorse or promote", r"may (?:not )?be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-warranty", "holders and contributors", r"this software is provided by the copyright holders and contributors as is"),
    ("bsd-warranty", "regents and contributors", r"this software is provided by the regents and contributors as is"),
    ("bsd-warranty", "owner or contributors", r"in no event shall the copyright owner or contributors be liable"),
    ("bsd-style", "bsd style", r"governed by a bsd style license"),
    ("bsd-patents", "additional grant of patent", r"additional grant of patent rights"),
    ("isc-text", "with or without fee", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-warranty", "author disclaims", r"the author disclaims all warranties with regard to this software"),
    ("hpnd", "without fee is hereby", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("apache-2.0-notice", "except in compliance", r"you may not use this (?:file|work) except in compliance with the license"),
    ("apache-2.0-notice", "obtain a copy of the license", r"you may obtain a copy of the license at"),
    ("apache-2.0-notice", "unless required by", r"unless required by applicable law or agreed to in writing"),
    ("apache-2.0-text", "irrevocable copyright", r"perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2.0-text", "irrevocable except", r"perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license"),
    ("apache-2.0-url", "org licenses license", r"apache org licenses license 2 0"),
    ("asf", "apache software foundation", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("gpl-notice", "you can redistribute", r"this program is free software you can redistribute it and or modify it"),
    ("lgpl-notice", "you can redistribute", r"this library is free software you can redistribute it and or modify it"),
    ("gpl-2.0-or-later", "version 2 of the", r"either version 2 of the license or at your option any later version"),
    ("lgpl-2.1-or-later", "version 2 1 of", r"either version 2 1 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "version 3 of the", r"either version 3 of the license or at your option any later version"),
    ("gpl-2.0-only", "version 2 as published", r"(?:gnu )?general public license version 2 as published by the free software foundation"),
    ("gpl-warranty", "in the hope that", r"distributed in the hope that it will be useful but without any warranty"),
    ("gpl-copy", "received a copy", r"you should have received a copy of the gnu general public license"),
    ("lgpl-copy", "received a copy", r"you should have received a copy of the gnu lesser general public license"),
    ("agpl-copy", "received a copy", r"you should have received a copy of the gnu affero general public license"),
    ("gpl-text", "verbatim copies", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl-2.0-text", "take away your freedom", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0-text", "copyleft license for", r"is a free copyleft license for software and other kinds of works"),
    ("gpl-url", "gnu org licenses", r"(?:www )?gnu org licenses"),
    ("gpl-classpath", "linking this library", r"linking this library statically or dynamically with other modules is making a combined work"),
    ("gpl-font", "font exception", r"gpl font exception"),
    ("gpl-font", "font embedding", r"font embedding exception"),
    ("gpl-linking", "linking exception", r"gpl linking exception"),
    ("gfdl-notice", "free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl-notice", "invariant sections", r"with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0-notice", "source code form", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0-notice", "copy of the mpl", r"if a copy of the mpl was not distributed with this file"),
    ("mpl-1.1-notice", "contents of this file", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0-text", "incompatible with secondary", r"incompatible with secondary licenses"),
    ("epl-notice", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cpl-1.0", "common public", r"common public license(?: v(?:ersion)? ?1 0)?"),
    ("ibmpl-1.0", "ibm public", r"ibm public license"),
    ("cddl-notice", "common development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("zlib-text", "express or implied", r"this software is provided as is without any express or implied warranty"),
    ("zlib-text", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib-text", "plainly marked", r"altered source versions must be plainly marked as such"),
    ("zlib-text", "source distribution", r"this notice may not be removed or altered from any source distribution"),
    ("libpng", "png reference library", r"png reference library license"),
    ("boost-text", "person or organization", r"to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense-text", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense-text", "free to copy modify", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0-text", "neighboring rights", r"waived all copyright and related or neighboring rights"),
    ("cc0-url", "publicdomain zero", r"creativecommons org publicdomain zero"),
    ("public-domain-mark", "publicdomain mark", r"creativecommons org publicdomain mark"),
    ("cc-by-nc-url", "licenses by nc", r"creativecommons org licenses by nc(?: sa| nd)?"),
    ("cc-by-sa-url", "licenses by sa", r"creativecommons org licenses by sa"),
    ("cc-by-nd-url", "licenses by nd", r"creativecommons org licenses by nd"),
    ("cc-by-url", "org licenses by", r"creativecommons org licenses by"),
    ("cc-notice", "creative commons", r"this work is licensed under (?:a|the) creative commons"),
    ("open-access", "open access article", r"this is an open access article"),
    ("open-access", "unrestricted use", r"permits unrestricted use distribution and reproduction in any medium"),
    ("wtfpl-text", "what the fuck", r"do what the fuck you want to(?: public license)?"),
    ("beerware", "beer ware", r"(?:the )?beer ware license"),
    ("beerware", "whatever you want with", r"you can do whatever you want with this stuff"),
    ("vim", "vim license", r"vim license"),
    ("curl", "curl license", r"curl license"),
    ("psf", "python software foundation", r"this license agreement is between the python software foundation"),
    ("openssl-text", "openssl project", r"this product includes software developed by the openssl project"),
    ("ssleay", "eric young", r"this product includes cryptographic software written by eric young"),
    ("perl", "same terms as perl", r"under the same terms as perl(?: 5 programming language system)? itself"),
    ("artistic-text", "a package may be copied", r"state the conditions under which a package may be copied"),
    ("ruby", "terms as ruby", r"under the same terms as ruby"),
    ("ofl-text", "font software is licensed", r"this font software is licensed under the sil open font license"),
    ("ofl-text", "reserved font name", r"with reserved font names?"),
    ("ms-pl-text", "accompanying software", r"this license governs use of the accompanying software"),
    ("ms-rl", "reciprocal", r"microsoft reciprocal license"),
    ("ncsa", "ncsa open source", r"(?:university of illinois )?ncsa open source license"),
    ("cecill", "cecill", r"cecill(?: [bc])?(?: (?:free software )?license)?"),
    ("mulan", "mulan", r"mulan (?:psl|permissive software license)"),
    ("json", "good not evil", r"the software shall be used for good not evil"),
    ("sspl-1.0", "server side public", r"server side public license"),
    ("busl-1.1", "business source", r"business source license(?: 1 1)?"),
    ("elastic-2.0", "elastic license", r"elastic license(?: 2 0)?"),
    ("commons-clause", "commons clause", r"commons clause(?: license condition)?"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter) license"),
    ("hippocratic", "hippocratic", r"hippocratic license"),
    ("osl-3.0", "open software license", r"open software license(?: v(?:ersion)?)?(?: ?3 0)?"),
    ("qpl-1.0", "q public", r"q public license"),
    ("sleepycat", "sleepycat", r"sleepycat (?:public )?license"),
    ("x11", "x consortium", r"(?:the )?x consortium(?: license)?"),
    ("ijg", "jpeg group", r"independent jpeg group s? ?(?:license|software)"),
    ("freetype", "freetype", r"freetype (?:project )?license"),
    ("info-zip", "info zip", r"info zip license"),
    ("w3c", "w3c software", r"w3c software (?:notice and )?(?:and document )?license"),
    ("unicode", "unicode", r"unicode (?:data files and software )?license(?: agreement)?"),
    ("upl-1.0", "universal permissive", r"universal permissive license(?: v(?:ersion)? ?1 0)?"),
    ("eupl-notice", "licensed under the eupl", r"licensed under the eupl"),
    ("odc-by", "open data commons", r"open data commons attribution license"),
    ("pddl", "dedication and license", r"(?:open data commons )?public domain dedication and license"),
    ("cdla", "community data", r"community data license agreement(?: permissive| sharing)?"),
    ("ogl", "open government", r"open government licen[cs]e(?: v?[123](?: 0)?)?"),
    ("crown", "crown copyright", r"(?:c )?crown copyright"),
    ("openrail", "openrail", r"(?:creative ml |bigscience bloom |bigcode )?openrail m?(?: license)?|openrail"),
    ("rail", "bigscience", r"bigscience (?:bloom )?rail license"),
    ("llama", "community license agreement", r"llama [234](?: [0-9])? community license agreement"),
    ("gemma", "gemma terms", r"gemma terms of use"),
    ("public-domain", "in the public domain", r"(?:this work|this file|this document|this software) is in the public domain"),
    ("no-known-copyright", "known copyright", r"no known copyright(?: restrictions)?"),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "proprietary information", r"confidential and proprietary information of"),
    ("proprietary", "trade secret", r"(?:contains|constitutes) (?:valuable )?trade secrets?"),
    ("proprietary", "no part of this", r"no part of this (?:publication|book|document|work) may be reproduced"),
    ("proprietary", "in whole or in part", r"reproduction in whole or in part without (?:written )?permission is prohibited"),
    ("proprietary", "internal use only", r"for internal use only"),
    ("proprietary", "written permission", r"without (?:the )?(?:prior |express )?(?:prior )?written permission of the (?:publisher|author|copyright owner|copyright holder)"),
    ("proprietary", "licensed not sold", r"(?:is|are) licensed not sold"),
    ("eula", "end user license", r"end user license agreement"),
    ("noncommercial", "commercial purposes", r"(?:not be used|may not use (?:this|the) (?:work|material|file)) for commercial purposes"),
    ("contributor", "contributor license", r"contributor license agreement"),
    ("see-license", "see the license file", r"see the license file(?: for details)?"),
    ("see-license", "see license", r"see license (?:md|txt)(?: for details)?"),
    ("multiple", "licensed", r"(?:dual|triple|multi) licensed"),
)
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def rules() -> list[tuple[int, str, str, str]]:
    """(priority, label, keyword, expression), several hundred; a smaller priority goes first."""
    out: list[tuple[str, str, str]] = []
    out += [(f"spdx:{t.replace(' ', '-')}", "spdx", rf"spdx license identifier {t}") for t in TAGGED]
    out += [(f"cc-{label}-{v.replace(' ', '.')}", "cc by", rf"cc {words} {v}(?: international| unported| generic)?") for label, words, _ in CONDITIONS for v in VERSIONS]
    out += [(f"cc-{label}-{v.replace(' ', '.')}", "creative", rf"creative commons {spelt}(?: only)? {v}(?: international| unported| generic)?") for label, _, spelt in CONDITIONS for v in VERSIONS]
    out += [(f"cc-{label}", "cc by", rf"cc {words}") for label, words, _ in CONDITIONS]
    out += [(f"cc-{label}", "creative", rf"creative commons {spelt}") for label, _, spelt in CONDITIONS]
    out += list(NAMES)
    out += list(NOTICES)
    # the label of a rule that ends with a colon goes on with the last word of what it detects
    out += [("grant:", g, rf"{g}(?: (?:the|an?))? (?:{GRANTED})") for g in GRANTS]
    return [(i, *r) for i, r in enumerate(out)]


def stems() -> list[str]:
    """A text without any of these holds no detection: the rules' keywords without those that hold another one."""
    words = {k for _, _, k, _ in rules()}
    return sorted(k for k in words if not any(o != k and o in k for o in words))


def normal(text: Column) -> Column:
    """A text's words, A-Z lower-cased, each between two single spaces; without words two spaces."""
    spaced = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), _SEPARATORS, " ")
    return F.concat(F.lit(" "), F.trim(spaced), F.lit(" "))


def words_in(spaced: Column) -> Column:
    """Words of a normal text or of a piece that ends between words."""
    return F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))


def starts(spaced: Column, expression: Column) -> Column:
    """(at, end, last) of each detection in a normal text, counted in words, and its last word."""
    whole = F.concat(F.lit("(?<= )(?:"), expression, F.lit(")(?= )"))
    found = F.regexp_extract_all(spaced, F.concat(F.lit("("), whole, F.lit(")")), F.lit(1))

    def placed(hits: Column) -> Column:
        between = F.call_function("split", spaced, whole, F.lit(-1))
        # spaces up to the end of each detection; the first gap begins with a space of its own
        spaces = F.zip_with(F.slice(between, F.lit(1), F.size(hits)), hits, lambda b, h: words_in(b) + words_in(h))
        size = lambda h: words_in(h) + 1
        one = lambda to, h: F.struct((to - size(h)).alias("at"), to.alias("end"), F.substring_index(h, " ", -1).alias("last"))
        return F.zip_with(running(spaces, lambda a, b: a + b), hits, one)

    return let(found, placed)


def detections(spaced: Column, of: list[tuple[int, str, str, str]]) -> Column:
    """(at, end, priority, label) of what the rules find and suppression leaves, in order."""
    table = F.array(*(F.struct(F.lit(p).alias("priority"), F.lit(label).alias("label"), F.lit(k).alias("keyword"), F.lit(x).alias("x")) for p, label, k, x in of))

    def found(open_: Column) -> Column:
        named = lambda r, d: F.when(F.endswith(r["label"], F.lit(":")), F.concat(r["label"], d["last"])).otherwise(r["label"])
        # longest first among those that start together, then by priority
        each = F.transform(open_, lambda r: F.transform(starts(spaced, r["x"]), lambda d: F.struct(d["at"].alias("at"), (-d["end"]).alias("to"), r["priority"].alias("priority"), named(r, d).alias("label"))))
        return let(F.sort_array(F.flatten(each)), lambda all_: let(running(F.transform(all_, lambda d: -d["to"]), F.greatest), lambda reach: kept(all_, reach)))

    def kept(all_: Column, reach: Column) -> Column:
        # what contains a detection stands before it and reaches as far
        free = F.filter(all_, lambda d, i: (i == 0) | F.coalesce(F.get(reach, i - 1) < -d["to"], F.lit(True)))
        return F.transform(free, lambda d: F.struct(d["at"].alias("at"), (-d["to"]).alias("end"), d["priority"].alias("priority"), d["label"].alias("label")))

    return let(F.filter(table, lambda r: F.contains(spaced, r["keyword"])), found)


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) for every row of ``docs``
    (doc_id, text).

    Null and wordless texts have no words and no labels; repeated rows are scanned each; an empty table gives no rows;
    other columns are not looked at. The score is the share of a text's words that detections cover, or 1 - 0.5 ** n for
    n detections if that is more. Nothing is shuffled. Whole texts are scanned however long: places and suppression take
    n log n steps for n detections, in memory that follows the text. Overlaps of which none contains the other all stay.
    """
    spaced, base, own = (free_name(docs, x) for x in ("spaced", "base", "own"))
    s = F.col(spaced)
    rows = docs.select("doc_id", F.explode(F.array(normal(F.col("text")))).alias(spaced))
    # a gap to the first or from the last place of a phrase, by what stands around it
    counts = [F.regexp_count(s, F.lit(f"(?<= ){p}(?= )")) for p, _ in BASE]
    firsts = [F.when(c > 0, words_in(F.substring_index(s, f" {p} ", 1))) for c, (p, _) in zip(counts, BASE, strict=True)]
    lasts = [F.when(c > 0, words_in(s) - 1 - words_in(F.substring_index(s, f" {p} ", -1)) - len(p.split(" "))) for c, (p, _) in zip(counts, BASE, strict=True)]
    any_base = F.struct(
        sum(counts[1:], counts[0]).cast("long").alias("n"),
        F.least(*firsts).cast("long").alias("first"),
        F.greatest(*lasts).cast("long").alias("last"),
        F.array_compact(F.array(*(F.when(c > 0, label) for c, (_, label) in zip(counts, BASE, strict=True)))).alias("labels"),
    )
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"), F.array().cast("array<string>").alias("labels"))
    has_base = F.contains(s, F.lit(f" {BASE[0][0]} ")) | F.contains(s, F.lit(f" {BASE[1][0]} ")) | F.contains(s, F.lit(f" {BASE[2][0]} "))
    gate = F.lit(False)
    for stem in stems():
        gate |= F.contains(s, F.lit(stem))
    empty = F.array().cast("array<struct<at:int,end:int,priority:int,label:string>>")
    rows = rows.select("doc_id", F.when(F.length(s) > 2, words_in(s) - 1).otherwise(0).cast("long").alias("n_words"), F.when(has_base, any_base).otherwise(none).alias(base), F.when(gate, detections(s, rules())).otherwise(empty).alias(own))
    b, d = F.col(base), F.col(own)
    covered = F.aggregate(d, F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")), lambda a, x: F.struct(F.greatest(a["to"], x["end"]).alias("to"), (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["to"], x["at"]))).alias("n")), lambda a: a["n"])
    share = F.when(F.col("n_words") > 0, covered / F.col("n_words")).otherwise(0.0)
    labels = F.array_sort(F.array_distinct(F.concat(b["labels"], F.transform(d, lambda x: x["label"]))))
    n = F.size(d) + F.when(F.size(d) == 0, b["n"]).otherwise(0)
    return rows.select(
        "doc_id",
        "n_words",
        b["n"].alias("n_base"),
        b["first"].alias("first_word"),
        b["last"].alias("last_word"),
        F.array_join(F.array_sort(b["labels"]), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(share, 1 - F.pow(F.lit(0.5), n)).alias("score"),
        d.alias("detections"),
    )
