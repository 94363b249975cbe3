"""License scans: ordered signature rules behind a keyword prefilter.

A text without any word of the gate is not looked at further. Others are brought to lower-case words joined by one
space. Each rule is written out: a label, a keyword, a priority, a confidence and a regular expression over such
words; only rules whose keyword occurs are tried, at all their places. Every expression is a literal of the plan, so
a task compiles it once. A detection that lies inside another of higher priority (or, at equal priority, inside a
longer one or an earlier rule's) is dropped, in one sweep over the sorted detections. Everything is DataFrame
functions on one row: no join and no shuffle. The result comes out of a generator, so that a filter on it stays
above the scan and is not worked into its expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents

#: Runs of what is not a letter, digit or non-ASCII character separate words.
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases that are always looked for, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Rules in order: label, keyword, priority, confidence, pattern.
RULES = r"""
mit | mit license | 60 | 1.0 | mit license
mit | mit licence | 60 | 1.0 | mit licence
mit | mit style | 40 | 0.8 | mit style licen[sc]e
mit | mit licensed | 50 | 0.95 | mit licensed
mit | identifier mit | 90 | 1.0 | spdx license identifier mit
mit | the mit | 70 | 1.0 | (licensed|released|distributed|available|published|provided) (under|by) (the terms of )?the mit( license)?
mit | permission is hereby | 90 | 1.0 | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | permission is hereby | 80 | 0.9 | permission is hereby granted free of charge
mit | copyright notice | 70 | 0.8 | the above copyright notice and this permission notice shall be included in all copies
mit | opensource org | 70 | 0.95 | opensource org licenses mit( license)?( php)?
mit-0 | mit no attribution | 80 | 1.0 | mit no attribution( license)?
mit-0 | mit 0 | 90 | 1.0 | spdx license identifier mit 0
x11 | x11 | 60 | 0.95 | x11 (style )?licen[sc]e
x11 | identifier x11 | 90 | 1.0 | spdx license identifier x11
isc | isc licen | 60 | 1.0 | isc licen[sc]e[ds]?
isc | identifier isc | 90 | 1.0 | spdx license identifier isc
isc | permission to use | 90 | 1.0 | permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted
isc | internet systems consortium | 50 | 0.7 | internet systems consortium licen[sc]e
apache | apache license | 60 | 0.95 | apache license
apache | apache license version | 65 | 1.0 | apache license version (1 0|1 1|2 0)
apache | apache licen | 62 | 0.95 | apache licen[sc]e (v )?2( 0)?
apache | apache 2 | 60 | 0.95 | apache 2 0 licen[sc]ed?
apache | identifier apache | 90 | 1.0 | spdx license identifier apache (1 0|1 1|2 0)
apache | apache software license | 62 | 0.95 | apache software license( version)?( 1 1| 2 0)?
apache | apache org licenses | 85 | 1.0 | (www )?apache org licenses( license 2 0)?( txt| html)?
apache | compliance with the license | 80 | 0.95 | you may not use this file except in compliance with the license
apache | copy of the license | 75 | 0.9 | you may obtain a copy of the license at
apache | applicable law | 75 | 0.9 | unless required by applicable law or agreed to in writing software distributed under the license
apache | asf | 40 | 0.7 | asf licensed
bsd | bsd licen | 60 | 0.95 | bsd licen[sc]ed?
bsd | bsd style | 50 | 0.85 | bsd style licen[sc]e
bsd | berkeley software | 50 | 0.8 | berkeley software distribution licen[sc]e
bsd | redistribution and use | 85 | 0.95 | redistribution and use in source and binary forms with or without modification are permitted
bsd | redistributions of source | 75 | 0.85 | redistributions of source code must retain the above copyright notice
bsd | redistributions in binary | 75 | 0.85 | redistributions in binary form must reproduce the above copyright notice
bsd-0 | 0bsd | 90 | 1.0 | (spdx license identifier )?0bsd
bsd-0 | zero clause bsd | 80 | 1.0 | (bsd )?zero clause bsd( licen[sc]e)?
bsd-2 | bsd 2 clause | 90 | 1.0 | (spdx license identifier )?bsd 2 clause( licen[sc]e)?
bsd-2 | 2 clause bsd | 80 | 1.0 | 2 clause bsd( licen[sc]e)?
bsd-2 | two clause bsd | 80 | 1.0 | two clause bsd( licen[sc]e)?
bsd-2 | simplified bsd | 80 | 1.0 | simplified bsd( licen[sc]e)?
bsd-2 | freebsd licen | 70 | 0.9 | freebsd licen[sc]e
bsd-3 | bsd 3 clause | 90 | 1.0 | (spdx license identifier )?bsd 3 clause( licen[sc]e)?
bsd-3 | 3 clause bsd | 80 | 1.0 | 3 clause bsd( licen[sc]e)?
bsd-3 | three clause bsd | 80 | 1.0 | three clause bsd( licen[sc]e)?
bsd-3 | new bsd | 80 | 1.0 | new bsd( licen[sc]e)?
bsd-3 | modified bsd | 80 | 1.0 | modified bsd( licen[sc]e)?
bsd-3 | revised bsd | 80 | 1.0 | revised bsd( licen[sc]e)?
bsd-3 | neither the name | 85 | 0.9 | neither the name of .{1,80}? may be used to endorse or promote products
bsd-4 | bsd 4 clause | 90 | 1.0 | (spdx license identifier )?bsd 4 clause( licen[sc]e)?
bsd-4 | original bsd | 80 | 1.0 | original bsd( licen[sc]e)?
bsd-4 | all advertising materials | 85 | 0.9 | all advertising materials mentioning features or use of this software must display
gpl | general public license | 60 | 0.95 | (gnu )?general public license
gpl | general public licen | 65 | 1.0 | (gnu )?general public licen[sc]e (version |v )?[123]( 0)?
gpl | gnu gpl | 60 | 0.95 | gnu gpl( licen[sc]e)?( v| version)?( [123])?
gpl | gplv | 65 | 1.0 | gplv[123]( licen[sc]ed?)?
gpl | gpl licen | 60 | 0.95 | gpl licen[sc]ed?
gpl | gpl compatible | 30 | 0.5 | gpl compatible
gpl | the gpl | 55 | 0.9 | (under|by) (the terms of )?the gpl
gpl | identifier gpl | 90 | 1.0 | spdx license identifier gpl [123] 0( only| or later)?
gpl | gpl 2 | 70 | 0.95 | gpl 2 0 (only|or later)
gpl | gpl 3 | 70 | 0.95 | gpl 3 0 (only|or later)
gpl | program is free software | 85 | 0.95 | this program is free software you can redistribute it and or modify it under the terms of
gpl | free software foundation | 50 | 0.6 | as published by the free software foundation
gpl | any later version | 55 | 0.6 | (at your option )?any later version
gpl | gnu org | 70 | 0.9 | (www )?gnu org (licenses|copyleft)( gpl)?( 2 0| 3 0)?( html| txt)?
gpl | received a copy | 75 | 0.9 | you should have received a copy of the gnu general public license along with this program
gpl-exception | classpath exception | 85 | 0.95 | classpath exception( 2 0)?
gpl-exception | linking exception | 80 | 0.9 | linking exception
lgpl | lesser general public | 75 | 1.0 | (gnu )?lesser general public licen[sc]e( version| v)?( 2 1| 3( 0)?)?
lgpl | library general public | 75 | 1.0 | (gnu )?library general public licen[sc]e( version| v)?( 2( 0)?)?
lgpl | gnu lgpl | 70 | 0.95 | gnu lgpl( v| version)?( [23])?( [01])?
lgpl | lgplv | 70 | 1.0 | lgplv(2|2 1|3)
lgpl | lgpl licen | 65 | 0.95 | lgpl licen[sc]ed?
lgpl | the lgpl | 60 | 0.9 | (under|by) (the terms of )?the lgpl
lgpl | identifier lgpl | 90 | 1.0 | spdx license identifier lgpl (2 0|2 1|3 0)( only| or later)?
lgpl | library is free software | 90 | 0.95 | this library is free software you can redistribute it and or modify it under the terms of
agpl | affero general public | 80 | 1.0 | (gnu )?affero general public licen[sc]e( version| v)?( [13]( 0)?)?
agpl | gnu agpl | 75 | 1.0 | gnu agpl( v| version)?( 3)?
agpl | agplv | 75 | 1.0 | agplv[13]
agpl | agpl licen | 70 | 0.95 | agpl licen[sc]ed?
agpl | identifier agpl | 90 | 1.0 | spdx license identifier agpl [13] 0( only| or later)?
fdl | free documentation | 75 | 1.0 | (gnu )?free documentation licen[sc]e( version| v)?( 1 [123])?
fdl | gfdl | 70 | 0.95 | gfdl( 1 [123])?
fdl | invariant sections | 60 | 0.8 | with no invariant sections( no front cover texts)?( and no back cover texts)?
mpl | mozilla public | 75 | 1.0 | mozilla public licen[sc]e( version| v)?( 1 0| 1 1| 2 0)?
mpl | identifier mpl | 90 | 1.0 | spdx license identifier mpl (1 0|1 1|2 0)
mpl | mozilla org mpl | 85 | 1.0 | mozilla org mpl( 2 0| 1 1)?
mpl | source code form | 85 | 0.95 | this source code form is subject to the terms of the
mpl | mpl licen | 60 | 0.9 | mpl licen[sc]ed?
mpl | mpl 2 | 60 | 0.9 | mpl 2 0
epl | eclipse public | 75 | 1.0 | eclipse public licen[sc]e( version| v)?( [12] 0)?
epl | identifier epl | 90 | 1.0 | spdx license identifier epl [12] 0
epl | eclipse org legal | 80 | 0.95 | eclipse org legal epl( v10| 2 0)?( html)?
edl | eclipse distribution | 75 | 1.0 | eclipse distribution licen[sc]e( v)?( 1 0)?
cddl | common development and | 75 | 1.0 | common development and distribution licen[sc]e( version| v)?( 1 [01])?
cddl | identifier cddl | 90 | 1.0 | spdx license identifier cddl 1 [01]
cddl | cddl licen | 60 | 0.9 | cddl licen[sc]ed?
cpl | common public licen | 75 | 1.0 | common public licen[sc]e( version| v)?( 1 0)?
cpal | common public attribution | 75 | 1.0 | common public attribution licen[sc]e( version)?( 1 0)?
ipl | ibm public | 75 | 1.0 | ibm public licen[sc]e( version| v)?( 1 0)?
eupl | european union public | 75 | 1.0 | european union public licen[sc]e( version| v)?( 1 [012])?
eupl | eupl | 65 | 0.95 | eupl( v| version)?( 1 [012])?
cecill | cecill | 65 | 0.95 | cecill( b| c)?( licen[sc]e)?( version)?( [12] [01])?
artistic | artistic licen | 70 | 1.0 | artistic licen[sc]e( version)?( [12] 0)?
artistic | identifier artistic | 90 | 1.0 | spdx license identifier artistic [12] 0
artistic | terms as perl | 70 | 0.9 | (under )?the same terms as perl( itself)?
boost | boost software | 75 | 1.0 | boost software licen[sc]e( version| v)?( 1 0)?
boost | identifier bsl 1 | 90 | 1.0 | spdx license identifier bsl 1 0
boost | boost org license | 85 | 1.0 | (www )?boost org license 1 0( txt)?
zlib | zlib licen | 65 | 1.0 | zlib licen[sc]e
zlib | zlib libpng | 70 | 1.0 | zlib libpng licen[sc]e
zlib | identifier zlib | 90 | 1.0 | spdx license identifier zlib
zlib | express or implied warranty | 80 | 0.8 | provided as is without any express or implied warranty in no event will the authors be held liable
zlib | origin of this software | 80 | 0.9 | the origin of this software must not be misrepresented
libpng | libpng licen | 65 | 0.95 | libpng licen[sc]e( version)?( 2( 0)?)?
unlicense | unlicense | 70 | 1.0 | (the )?unlicense
unlicense | unencumbered software | 90 | 1.0 | this is free and unencumbered software released into the public domain
unlicense | unlicense org | 85 | 1.0 | unlicense org
wtfpl | wtfpl | 70 | 1.0 | wtfpl( version| v)?( [12])?
wtfpl | what the fuck | 80 | 1.0 | do what the fuck you want to( public licen[sc]e)?
cc0 | cc0 | 70 | 1.0 | cc0( 1 0)?( universal)?( licen[sc]e)?
cc0 | publicdomain zero | 90 | 1.0 | creativecommons org publicdomain zero 1 0
cc0 | creative commons zero | 80 | 1.0 | creative commons zero( v1 0)?( universal)?
cc-by | creative commons attribution | 60 | 1.0 | creative commons attribution( [1234] [05])?( international| unported| generic)?( licen[sc]e)?
cc-by-sa | creative commons attribution share | 70 | 1.0 | creative commons attribution share ?alike( [1234] [05])?( international| unported)?( licen[sc]e)?
cc-by-nc | creative commons attribution non | 70 | 1.0 | creative commons attribution non ?commercial( [1234] [05])?( international| unported)?( licen[sc]e)?
cc-by-nd | creative commons attribution no | 70 | 1.0 | creative commons attribution no ?deriv(ative)?s?( works)?( [1234] [05])?( licen[sc]e)?
cc-by-nc-sa | creative commons attribution non | 75 | 1.0 | creative commons attribution non ?commercial share ?alike( [1234] [05])?( licen[sc]e)?
cc-by-nc-nd | creative commons attribution non | 75 | 1.0 | creative commons attribution non ?commercial no ?deriv(ative)?s?( works)?( [1234] [05])?( licen[sc]e)?
cc-by | cc by | 50 | 0.95 | licen[sc]ed? (under )?(a |the )?cc by( [1234] [05])?
cc-by-sa | cc by sa | 60 | 0.95 | licen[sc]ed? (under )?(a |the )?cc by sa( [1234] [05])?
cc-by-nc | cc by nc | 60 | 0.95 | licen[sc]ed? (under )?(a |the )?cc by nc( [1234] [05])?
cc-by-nd | cc by nd | 60 | 0.95 | licen[sc]ed? (under )?(a |the )?cc by nd( [1234] [05])?
cc-by-nc-sa | cc by nc sa | 70 | 0.95 | licen[sc]ed? (under )?(a |the )?cc by nc sa( [1234] [05])?
cc-by-nc-nd | cc by nc nd | 70 | 0.95 | licen[sc]ed? (under )?(a |the )?cc by nc nd( [1234] [05])?
cc-by | creativecommons org licenses by | 70 | 1.0 | creativecommons org licenses by( [1-4] [05])?
cc-by-sa | creativecommons org licenses by sa | 80 | 1.0 | creativecommons org licenses by sa( [1-4] [05])?
cc-by-nc | creativecommons org licenses by nc | 80 | 1.0 | creativecommons org licenses by nc( [1-4] [05])?
cc-by-nd | creativecommons org licenses by nd | 80 | 1.0 | creativecommons org licenses by nd( [1-4] [05])?
cc-by-nc-sa | creativecommons org licenses by nc sa | 85 | 1.0 | creativecommons org licenses by nc sa( [1-4] [05])?
cc-by-nc-nd | creativecommons org licenses by nc nd | 85 | 1.0 | creativecommons org licenses by nc nd( [1-4] [05])?
ofl | open font licen | 75 | 1.0 | (sil )?open font licen[sc]e( version)?( 1 [01])?
ofl | identifier ofl | 90 | 1.0 | spdx license identifier ofl 1 [01]
ofl | reserved font name | 75 | 0.9 | with reserved font names?
ofl | scripts sil org | 80 | 0.95 | scripts sil org ofl
psf | python software foundation | 75 | 1.0 | python software foundation licen[sc]e( version| v)?( 2)?
psf | psf license | 65 | 0.95 | psf license( agreement)?( 2)?
python | python licen | 60 | 0.9 | python licen[sc]e( 2 0)?
ruby | ruby licen | 60 | 0.9 | ruby licen[sc]e
ruby | terms as ruby | 65 | 0.9 | (under )?the same terms as ruby( itself)?
php | php licen | 60 | 0.95 | php licen[sc]e( version| v)?( 3 01| 3 0)?
postgresql | postgresql licen | 65 | 1.0 | postgresql licen[sc]e
openssl | openssl licen | 65 | 1.0 | openssl licen[sc]e
openssl | openssl project | 80 | 0.9 | this product includes software developed by the openssl project
osl | open software licen | 70 | 1.0 | open software licen[sc]e( version| v)?( 1 0| 2 0| 2 1| 3 0)?
afl | academic free licen | 70 | 1.0 | academic free licen[sc]e( version| v)?( 1 1| 1 2| 2 0| 2 1| 3 0)?
ecl | educational community licen | 70 | 1.0 | educational community licen[sc]e( version)?( [12] 0)?
ms-pl | microsoft public licen | 75 | 1.0 | microsoft public licen[sc]e( ms pl)?
ms-pl | ms pl | 60 | 0.9 | ms pl licen[sc]e
ms-rl | microsoft reciprocal licen | 75 | 1.0 | microsoft reciprocal licen[sc]e( ms rl)?
ms-rl | ms rl | 60 | 0.9 | ms rl licen[sc]e
upl | universal permissive licen | 70 | 1.0 | universal permissive licen[sc]e( version| v)?( 1 0)?
ncsa | ncsa | 65 | 0.95 | (university of illinois )?ncsa( open source)? licen[sc]e
w3c | w3c software | 70 | 1.0 | w3c software( notice and| and document notice and)? licen[sc]e
zpl | zope public licen | 70 | 1.0 | zope public licen[sc]e( version| v)?( 1 1| 2 [01])?
odbl | open database licen | 70 | 1.0 | open database licen[sc]e( v)?( 1 0)?
odbl | odbl | 65 | 0.95 | odbl( v| version)?( 1 0)?
odc-by | open data commons attribution | 75 | 1.0 | open data commons attribution licen[sc]e( v)?( 1 0)?
pddl | public domain dedication and | 75 | 1.0 | public domain dedication and licen[sc]e( v)?( 1 0)?
bsl | business source licen | 70 | 1.0 | business source licen[sc]e( version)?( 1 [01])?
sspl | server side public licen | 70 | 1.0 | server side public licen[sc]e( version| v)?( 1)?
sspl | identifier sspl | 90 | 1.0 | spdx license identifier sspl 1 0
elastic | elastic licen | 65 | 0.95 | elastic licen[sc]e( version| v)?( 2( 0)?)?
polyform | polyform | 65 | 0.95 | polyform (noncommercial|small business|shield|strict|free trial)( licen[sc]e)?( 1 0 0)?
mulan | mulan | 65 | 1.0 | mulan (permissive software licen[sc]e|psl)( version| v)?[12]?
vim | vim licen | 60 | 0.95 | vim licen[sc]e
beerware | beer ware | 70 | 1.0 | beer ware( licen[sc]e)?( revision 42)?
beerware | beerware | 70 | 1.0 | beerware( licen[sc]e)?
beerware | buy me a beer | 80 | 1.0 | you can buy me a beer in return
json | json licen | 60 | 0.95 | json licen[sc]e
json | used for good | 80 | 0.95 | the software shall be used for good not evil
qpl | q public licen | 70 | 1.0 | q public licen[sc]e( version)?( 1 0)?
sleepycat | sleepycat licen | 65 | 1.0 | sleepycat licen[sc]e
bittorrent | bittorrent open source | 70 | 1.0 | bittorrent open source licen[sc]e
unicode | unicode licen | 65 | 0.95 | unicode licen[sc]e( agreement| v3)?
ftl | freetype | 60 | 0.95 | freetype (project )?licen[sc]e
ijg | independent jpeg group | 70 | 0.9 | independent jpeg group( licen[sc]e)?
curl | curl licen | 60 | 0.95 | curl licen[sc]e
openldap | openldap public | 70 | 1.0 | openldap public licen[sc]e( version)?( 2 8)?
public-domain | public domain | 50 | 0.8 | (released|placed|dedicated|put) (in|into|to) the public domain
public-domain | public domain | 30 | 0.6 | (is|are|be) in the public domain
public-domain | public domain | 20 | 0.5 | public domain
proprietary | proprietary and confidential | 60 | 0.8 | proprietary and confidential
proprietary | all rights reserved | 40 | 0.6 | all rights reserved
proprietary | unauthorized copying | 60 | 0.8 | unauthorized copying of this (file|software)( via any medium)? is strictly prohibited
proprietary | trade secret | 50 | 0.7 | contains (confidential information and )?trade secrets?
proprietary | without permission | 50 | 0.7 | (may not|must not|no part of this .{1,40}? may) be (copied|reproduced|distributed|used) without permission
proprietary | without prior written | 50 | 0.7 | without (the )?prior written (permission|consent)
proprietary | end user license | 50 | 0.8 | end user license agreement
commercial | commercial licen | 40 | 0.7 | commercial licen[sc]e
copyright | copyright | 10 | 0.5 | copyright (c )?((19|20)[0-9][0-9] )*(19|20)[0-9][0-9]
spdx | spdx license identifier | 15 | 0.5 | spdx license identifier
"""

#: Some word of every pattern, outside its optional parts.
GATE = ["licen", "gpl", "permission", "copyright", "apache", "applicable", "bsd", "redistribut", "endorse", "advertis", "foundation", "later", "gnu"]
GATE += ["exception", "gfdl", "invariant", "mozilla", "subject", "mpl", "eclipse", "eupl", "cecill", "perl", "ruby", "express", "misrepresented"]
GATE += ["unencumbered", "wtfpl", "fuck", "cc0", "publicdomain", "creative", "reserved", "scripts", "openssl", "odbl", "polyform", "mulan", "beer", "evil"]
GATE += ["jpeg", "domain", "proprietary", "unauthorized", "secret", "written"]

BLOCK = 256


def rules() -> list[tuple[str, str, int, float, str]]:
    """(keyword, label, priority, confidence, pattern) of every rule, in order."""
    rows = [line.split(" | ") for line in RULES.strip().splitlines()]
    return [(k, label, int(p), float(c), pattern) for label, k, p, c, pattern in rows]


def running(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    """One output of type ``out`` an item, with a state carried along: step(state, item) gives the next state and the output.

    Outputs are joined in blocks, so the work grows in proportion to the items (and with a 256th of its square only in
    references).
    """
    none = F.array().cast(f"array<{out}>")

    def block(at: Column, b: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            nxt, made = step(acc["s"], x)
            return F.struct(nxt.alias("s"), F.concat(acc["o"], F.array(made)).alias("o"))

        return F.aggregate(F.slice(items, b * BLOCK + 1, F.lit(BLOCK)), F.struct(at.alias("s"), none.alias("o")), one)

    def outer(acc: Column, b: Column) -> Column:
        return F.get(F.transform(F.array(block(acc["s"], b)), lambda r: F.struct(r["s"].alias("s"), F.concat(acc["o"], F.array(r["o"])).alias("o"))), F.lit(0))

    blocks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(items) - 1) / BLOCK).cast("int"), F.lit(0)))
    start = F.struct(state.alias("s"), F.array().cast(f"array<array<{out}>>").alias("o"))
    return F.flatten(F.aggregate(blocks, start, outer)["o"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row.

    labels are those of the base phrases and of the detections that stay; score is the greatest confidence
    among these (1.0 for a base phrase), 0 without any. A null text counts as empty. Repeated rows each
    give a row; other columns are not read; an empty table gives an empty result. Whole texts of any length are scanned.
    """
    table = rules()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    low = F.lower("text")
    gate = reduce(lambda a, w: a | low.contains(w), GATE, F.lit(False))
    rows = rows.withColumn("n_words", F.size(F.array_remove(F.split("text", APART), "")).cast("long"))
    spaced = F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.translate("text", UPPER, LOWER), APART, " ")), F.lit(" "))
    rows = rows.withColumn("norm", F.when(gate, spaced)).drop("text")

    words = F.split(F.btrim("norm"), " ")
    rows = rows.withColumn("w", F.when(F.greatest(*[F.contains("norm", F.lit(f" {p} ")) for p in BASE]), words))
    base = F.array(*[F.struct(F.array(*map(F.lit, p.split(" "))).alias("p"), F.lit(label).alias("label")) for p, label in BASE.items()])
    starts = F.flatten(
        F.transform(base, lambda b: F.transform(F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.slice("w", i + 1, F.size(b["p"])) == b["p"]), lambda i: F.struct(i.alias("i"), b["label"].alias("label"))))
    )
    rows = rows.withColumn("hits", F.when(F.col("w").isNotNull(), starts)).drop("w")

    # Matches are put between two characters that the words cannot hold; what lies between these gives their places.
    tried = [F.when(F.contains("norm", F.lit(" " + k)), F.struct(F.lit(i).alias("i"), F.regexp_replace("norm", F.lit(f" {pattern}(?= )"), F.lit("\x01$0\x02")).alias("m"))) for i, (k, _, _, _, pattern) in enumerate(table)]
    hit = F.filter(F.array_compact(F.array(*tried)), lambda t: F.contains(t["m"], F.lit("\x01")))
    rows = rows.withColumn("tried", F.when(F.col("norm").isNotNull(), hit)).drop("norm")

    levels = sorted({r[2] for r in table}, reverse=True)
    level = F.array(*[F.lit(levels.index(r[2])) for r in table])

    def places(t: Column) -> Column:
        """The spans of a rule as (a, -z, level, rule): characters a to z, in sorting order."""
        lengths = F.transform(F.split(t["m"], "[\x01\x02]", -1), F.length)
        pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / 2).cast("int") - 1), lambda j: F.struct(F.get(lengths, 2 * j).alias("o"), F.get(lengths, 2 * j + 1).alias("m")))
        spans = running(pairs, F.lit(0), lambda s, x: (s + x["o"] + x["m"], F.struct((s + x["o"]).alias("a"), (-(s + x["o"] + x["m"])).alias("z"))), "struct<a:int,z:int>")
        return F.transform(spans, lambda s: F.struct(s["a"].alias("a"), s["z"].alias("z"), F.get(level, t["i"]).alias("v"), t["i"].alias("i")))

    rows = rows.withColumn("spans", F.when(F.size("tried") > 0, F.sort_array(F.flatten(F.transform("tried", places))))).drop("tried")

    def sweep(reach: Column, s: Column) -> tuple[Column, Column]:
        """reach: of each level the farthest end so far. Whatever holds a span comes before it in this order."""
        z = -s["z"]
        held = F.array_max(F.slice(reach, 1, s["v"] + 1)) >= z
        return F.transform(reach, lambda r, k: F.when(k == s["v"], F.greatest(r, z)).otherwise(r)), F.when(held, F.lit(-1)).otherwise(s["i"])

    kept = F.filter(running(F.col("spans"), F.array_repeat(F.lit(-1), len(levels)), sweep, "int"), lambda i: i >= 0)
    rows = rows.withColumn("stay", F.when(F.col("spans").isNotNull(), kept)).drop("spans")
    label, confidence = F.array(*[F.lit(r[1]) for r in table]), F.array(*[F.lit(r[3]) for r in table])
    none = F.array().cast("array<string>")
    base_labels = F.array_sort(F.array_distinct(F.coalesce(F.transform("hits", lambda h: h["label"]), none)))
    more = F.coalesce(F.transform(F.array_distinct("stay"), lambda i: F.get(label, i)), none)
    best = F.coalesce(F.array_max(F.transform(F.array_distinct("stay"), lambda i: F.get(confidence, i))), F.lit(0.0))
    n_base = F.coalesce(F.greatest(F.size("hits"), F.lit(0)), F.lit(0)).cast("long")
    out = F.struct(
        "n_words",
        n_base.alias("n_base"),
        F.array_min(F.transform("hits", lambda h: h["i"])).cast("long").alias("first_word"),
        F.array_max(F.transform("hits", lambda h: h["i"])).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, more))), ",").alias("labels"),
        F.when(F.size(F.coalesce("hits", F.array())) > 0, 1.0).otherwise(best).alias("score"),
        F.coalesce(F.greatest(F.size("stay"), F.lit(0)), F.lit(0)).alias("n_detections"),
    )
    return rows.select("doc_id", F.inline(F.array(out)))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
