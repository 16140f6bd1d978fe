"""Licence signatures, written by hand from the names, tags, notices and telling sentences of published licences.

One rule a line: label | kind | keyword | pattern. Patterns run over a text's lower-cased words joined by single spaces
(so 2.0 is "2 0" and cc-by is "cc by"). The keyword is a part of every match; a rule runs only where it occurs. Kinds
rank rules and give their confidence.
"""

from __future__ import annotations

from typing import NamedTuple

#: kind: priority, confidence.
KINDS = {"tag": (32, 1.0), "grant": (24, 0.95), "text": (18, 0.9), "version": (12, 0.8), "name": (10, 0.6), "hint": (4, 0.4)}


class Rule(NamedTuple):
    label: str
    priority: int
    confidence: float
    keyword: str
    pattern: str


SIGNATURES = """
gpl-1.0 | tag | identifier gpl | spdx license identifier gpl 1 0(?: only| or later)?
gpl-2.0 | tag | identifier gpl | spdx license identifier gpl 2 0(?: only| or later)?
gpl-3.0 | tag | identifier gpl | spdx license identifier gpl 3 0(?: only| or later)?
gpl-1.0 | grant | general public | (?:redistribute it and or modify it )?under the terms of the gnu general public licen[sc]e (?:as published by the free software foundation )?(?:either )?version 1
gpl-2.0 | grant | general public | (?:redistribute it and or modify it )?under the terms of the gnu general public licen[sc]e (?:as published by the free software foundation )?(?:either )?version 2(?: of the licen[sc]e)?(?: or (?:at your option )?any later version)?
gpl-3.0 | grant | general public | (?:redistribute it and or modify it )?under the terms of the gnu general public licen[sc]e (?:as published by the free software foundation )?(?:either )?version 3(?: of the licen[sc]e)?(?: or (?:at your option )?any later version)?
gpl | grant | general public | (?:licen[sc]ed|released|distributed|available|covered) under (?:the )?(?:terms of the )?(?:gnu )?general public licen[sc]e
gpl | grant | under the gpl | (?:licen[sc]ed|released|distributed|available|covered) under the gpl
gpl | text | free software | this program is free software you can redistribute it and or modify
gpl | text | hope that it | this program is distributed in the hope that it will be useful but without any warranty
gpl | text | should have received | you should have received a copy of the gnu general public licen[sc]e
gpl | text | designed to take away | the licen[sc]es for most software (?:and other practical works )?are designed to take away your freedom to share and change
gpl-3.0 | text | copyleft licen | the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works
gpl-1.0 | version | general public | (?:gnu )?general public licen[sc]e (?:version |v )?1(?: 0)?
gpl-2.0 | version | general public | (?:gnu )?general public licen[sc]e (?:version |v )?2(?: 0)?(?: june 1991)?(?: or later)?
gpl-3.0 | version | general public | (?:gnu )?general public licen[sc]e (?:version |v )?3(?: 0)?(?: 29 june 2007)?(?: or later)?
gpl-2.0 | version | gplv2 | (?:gnu )?gplv2(?: 0)?(?: or later)?
gpl-3.0 | version | gplv3 | (?:gnu )?gplv3(?: 0)?(?: or later)?
gpl-1.0 | version | gpl 1 | (?:gnu )?gpl 1 0
gpl-2.0 | version | gpl 2 | (?:gnu )?gpl 2(?: 0)?(?: only| or later)?
gpl-3.0 | version | gpl 3 | (?:gnu )?gpl 3(?: 0)?(?: only| or later)?
gpl-2.0 | version | gpl version 2 | (?:gnu )?gpl version 2(?: 0)?(?: or later)?
gpl-3.0 | version | gpl version 3 | (?:gnu )?gpl version 3(?: 0)?(?: or later)?
gpl | name | general public | (?:the )?gnu general public licen[sc]e
gpl | name | gnu gpl | gnu gpl
gpl-classpath | text | classpath exception | (?:gpl )?(?:with )?(?:the )?classpath exception
gpl-gcc-exception | text | runtime library exception | gcc runtime library exception
lgpl-2.0 | tag | identifier lgpl | spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 | tag | identifier lgpl | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0 | tag | identifier lgpl | spdx license identifier lgpl 3 0(?: only| or later)?
lgpl | grant | under the lgpl | (?:licen[sc]ed|released|distributed|available) under the lgpl
lgpl | grant | lesser general | (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?lesser general public licen[sc]e
lgpl-2.1 | grant | lesser general | under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation (?:either )?version 2 1(?: of the licen[sc]e)?(?: or (?:at your option )?any later version)?
lgpl-3.0 | grant | lesser general | under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation (?:either )?version 3(?: of the licen[sc]e)?(?: or (?:at your option )?any later version)?
lgpl | text | free software | this library is free software you can redistribute it and or modify
lgpl | text | should have received | you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e
lgpl-2.0 | version | library general | (?:gnu )?library general public licen[sc]e (?:version |v )?2(?: 0)?
lgpl-2.1 | version | lesser general | (?:gnu )?lesser general public licen[sc]e (?:version |v )?2 1
lgpl-3.0 | version | lesser general | (?:gnu )?lesser general public licen[sc]e (?:version |v )?3(?: 0)?
lgpl-2.1 | version | lgplv2 | (?:gnu )?lgplv2 1(?: or later)?
lgpl-3.0 | version | lgplv3 | (?:gnu )?lgplv3(?: 0)?(?: or later)?
lgpl-2.1 | version | lgpl 2 | (?:gnu )?lgpl 2 1(?: only| or later)?
lgpl-3.0 | version | lgpl 3 | (?:gnu )?lgpl 3(?: 0)?(?: only| or later)?
lgpl | name | lesser general | (?:gnu )?lesser general public licen[sc]e
lgpl | name | library general | (?:gnu )?library general public licen[sc]e
agpl-1.0 | tag | identifier agpl | spdx license identifier agpl 1 0(?: only| or later)?
agpl-3.0 | tag | identifier agpl | spdx license identifier agpl 3 0(?: only| or later)?
agpl-3.0 | grant | affero general | under the terms of the gnu affero general public licen[sc]e (?:as published by the free software foundation )?(?:either )?version 3(?: of the licen[sc]e)?(?: or (?:at your option )?any later version)?
agpl | grant | affero general | (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:gnu )?affero general public licen[sc]e
agpl | text | should have received | you should have received a copy of the gnu affero general public licen[sc]e
agpl-3.0 | version | affero general | (?:gnu )?affero general public licen[sc]e (?:version |v )?3(?: 0)?
agpl-3.0 | version | agplv3 | (?:gnu )?agplv3(?: 0)?(?: or later)?
agpl-3.0 | version | agpl 3 | (?:gnu )?agpl 3(?: 0)?(?: only| or later)?
agpl | name | affero general | (?:gnu )?affero general public licen[sc]e
gfdl-1.1 | tag | identifier gfdl | spdx license identifier gfdl 1 1(?: only| or later)?
gfdl-1.2 | tag | identifier gfdl | spdx license identifier gfdl 1 2(?: only| or later)?
gfdl-1.3 | tag | identifier gfdl | spdx license identifier gfdl 1 3(?: only| or later)?
gfdl | grant | documentation licen | under the terms of the gnu free documentation licen[sc]e
gfdl | text | invariant sections | with (?:no|the) invariant sections(?: no front cover texts and no back cover texts)?
gfdl-1.2 | version | documentation licen | gnu free documentation licen[sc]e (?:version |v )?1 2
gfdl-1.3 | version | documentation licen | gnu free documentation licen[sc]e (?:version |v )?1 3
gfdl | name | documentation licen | gnu free documentation licen[sc]e
apache-1.0 | tag | identifier apache | spdx license identifier apache 1 0
apache-1.1 | tag | identifier apache | spdx license identifier apache 1 1
apache-2.0 | tag | identifier apache | spdx license identifier apache 2 0
apache-2.0 | grant | apache license | licensed under the apache license version 2(?: 0)?
apache-2.0 | grant | apache license | (?:released|distributed|available|provided|published) under (?:the )?(?:terms of the )?apache license (?:version |v )?2(?: 0)?
apache | grant | apache licen | (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of the )?apache licen[sc]e
apache-2.0 | text | except in compliance | you may not use this file except in compliance with the licen[sc]e
apache-2.0 | text | apache org licenses | (?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?
apache-2.0 | text | as is basis | distributed on an as is basis without warranties or conditions of any kind either express or implied
apache-2.0 | text | terms and conditions for use | terms and conditions for use reproduction and distribution
apache-1.1 | text | apache software foundation | this product includes software developed by the apache software foundation
apache-1.1 | version | apache | apache (?:software )?licen[sc]e (?:version |v )?1 1
apache-2.0 | version | apache | apache (?:software )?licen[sc]e (?:version |v )?2(?: 0)?
apache-2.0 | version | apache 2 0 | apache 2 0(?: licen[sc]e)?
apache | name | apache | apache (?:software )?licen[sc]e
mit | tag | identifier mit | spdx license identifier mit
mit-0 | tag | identifier mit 0 | spdx license identifier mit 0
mit | grant | mit licen | (?:licen[sc]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of the )?mit licen[sc]e
mit | text | hereby granted | permission is hereby granted free of charge to any person obtaining a copy
mit | text | above copyright notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit | text | without warranty of any | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit | name | mit licen | (?:the )?mit licen[sc]e
mit | name | expat licen | (?:the )?expat licen[sc]e
x11 | tag | identifier x11 | spdx license identifier x11
x11 | text | x consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
x11 | name | x11 licen | (?:the )?x11 licen[sc]e
bsd-0-clause | tag | identifier 0bsd | spdx license identifier 0bsd
bsd-2-clause | tag | identifier bsd | spdx license identifier bsd 2 clause
bsd-3-clause | tag | identifier bsd | spdx license identifier bsd 3 clause(?: clear)?
bsd-4-clause | tag | identifier bsd | spdx license identifier bsd 4 clause
bsd | grant | bsd | (?:licen[sc]ed|released|distributed|available|provided) under (?:the |a )?(?:terms of the )?(?:modified |simplified |new |revised )?bsd(?: style)? licen[sc]e
bsd | text | source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd | text | redistributions of source | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | text | redistributions in binary | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | text | endorse or promote | neither the name of .{1,80}? (?:may|shall) be used to endorse or promote products derived from this software
bsd-4-clause | text | advertising materials | all advertising materials mentioning features or use of this software must display
bsd-2-clause | version | 2 clause | (?:the )?2 clause bsd(?: licen[sc]e)?
bsd-3-clause | version | 3 clause | (?:the )?3 clause bsd(?: licen[sc]e)?
bsd-4-clause | version | 4 clause | (?:the )?4 clause bsd(?: licen[sc]e)?
bsd-2-clause | version | bsd 2 | bsd 2 clause(?: licen[sc]e)?
bsd-3-clause | version | bsd 3 | bsd 3 clause(?: licen[sc]e)?
bsd-4-clause | version | bsd 4 | bsd 4 clause(?: licen[sc]e)?
bsd-2-clause | version | simplified bsd | simplified bsd licen[sc]e
bsd-3-clause | version | new bsd | new bsd licen[sc]e
bsd-3-clause | version | modified bsd | modified bsd licen[sc]e
bsd-3-clause | version | revised bsd | revised bsd licen[sc]e
bsd | name | bsd licen | (?:the )?bsd licen[sc]e
bsd | name | bsd style | bsd style licen[sc]e
isc | tag | identifier isc | spdx license identifier isc
isc | grant | isc licen | (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of the )?isc licen[sc]e
isc | text | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee
isc | name | isc licen | (?:the )?isc licen[sc]e
zlib | tag | identifier zlib | spdx license identifier zlib
zlib | grant | zlib | (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of the )?zlib(?: libpng)? licen[sc]e
zlib | text | altered source | altered source versions must be plainly marked as such
zlib | text | must not be misrepresented | the origin of this software must not be misrepresented
zlib | name | zlib | (?:the )?zlib(?: libpng)? licen[sc]e
libpng | tag | identifier libpng | spdx license identifier libpng(?: 2 0)?
mpl-1.0 | tag | identifier mpl | spdx license identifier mpl 1 0
mpl-1.1 | tag | identifier mpl | spdx license identifier mpl 1 1
mpl-2.0 | tag | identifier mpl | spdx license identifier mpl 2 0
mpl-2.0 | grant | mozilla public | subject to the terms of the mozilla public licen[sc]e v(?:ersion )? ?2 0
mpl-1.1 | grant | mozilla public | subject to the mozilla public licen[sc]e version 1 1
mpl | grant | mozilla public | (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of the )?mozilla public licen[sc]e
mpl-2.0 | text | mpl was not distributed | if a copy of the mpl was not distributed with this file you can obtain one
mpl-1.1 | version | mozilla public | mozilla public licen[sc]e (?:version |v )?1 1
mpl-2.0 | version | mozilla public | mozilla public licen[sc]e (?:version |v )?2(?: 0)?
mpl-1.1 | version | mpl 1 1 | mpl 1 1
mpl-2.0 | version | mpl 2 0 | mpl 2 0
mpl | name | mozilla public | mozilla public licen[sc]e
epl-1.0 | tag | identifier epl | spdx license identifier epl 1 0
epl-2.0 | tag | identifier epl | spdx license identifier epl 2 0
epl | grant | eclipse public | (?:made available|licen[sc]ed|released|distributed) under the terms of the eclipse public licen[sc]e
epl-1.0 | version | eclipse public | eclipse public licen[sc]e (?:version |v )?1(?: 0)?
epl-2.0 | version | eclipse public | eclipse public licen[sc]e (?:version |v )?2(?: 0)?
epl | name | eclipse public | eclipse public licen[sc]e
edl-1.0 | name | eclipse distribution | eclipse distribution licen[sc]e(?: (?:version |v )?1 0)?
cpl-1.0 | tag | identifier cpl | spdx license identifier cpl 1 0
cpl-1.0 | name | common public | common public licen[sc]e(?: (?:version |v )?1 0)?
cpal-1.0 | name | common public attribution | common public attribution licen[sc]e(?: (?:version |v )?1 0)?
ipl-1.0 | name | ibm public | ibm public licen[sc]e(?: (?:version |v )?1 0)?
cddl-1.0 | tag | identifier cddl | spdx license identifier cddl 1 0
cddl-1.1 | tag | identifier cddl | spdx license identifier cddl 1 1
cddl | grant | common development | subject to the terms of the common development and distribution licen[sc]e
cddl-1.0 | version | common development | common development and distribution licen[sc]e (?:version |v )?1 0
cddl-1.1 | version | common development | common development and distribution licen[sc]e (?:version |v )?1 1
cddl | name | common development | common development and distribution licen[sc]e
eupl-1.1 | tag | identifier eupl | spdx license identifier eupl 1 1
eupl-1.2 | tag | identifier eupl | spdx license identifier eupl 1 2
eupl-1.1 | version | european union public | european union public licen[sc]e (?:version |v )?1 1
eupl-1.2 | version | european union public | european union public licen[sc]e (?:version |v )?1 2
eupl | grant | european union public | licen[sc]ed under the european union public licen[sc]e
eupl | grant | under the eupl | licen[sc]ed under the eupl
eupl | name | european union public | european union public licen[sc]e
cecill | name | cecill | cecill(?: [abc])?(?: free software)? licen[sc]e(?: agreement)?
cecill-2.1 | tag | identifier cecill | spdx license identifier cecill 2 1
osl-3.0 | tag | identifier osl | spdx license identifier osl 3 0
osl-3.0 | version | open software | open software licen[sc]e (?:version |v )?3 0
osl-2.1 | version | open software | open software licen[sc]e (?:version |v )?2 1
osl | name | open software | open software licen[sc]e
afl-3.0 | tag | identifier afl | spdx license identifier afl 3 0
afl-3.0 | version | academic free | academic free licen[sc]e (?:version |v )?3 0
afl-2.1 | version | academic free | academic free licen[sc]e (?:version |v )?2 1
afl | name | academic free | academic free licen[sc]e
ecl-2.0 | name | educational community | educational community licen[sc]e(?: (?:version |v )?2 0)?
artistic-1.0 | tag | identifier artistic | spdx license identifier artistic 1 0(?: perl)?
artistic-2.0 | tag | identifier artistic | spdx license identifier artistic 2 0
artistic-1.0 | version | artistic licen | artistic licen[sc]e (?:version |v )?1 0
artistic-2.0 | version | artistic licen | artistic licen[sc]e (?:version |v )?2 0
artistic | grant | same terms as perl | under the same terms as perl(?: itself)?
artistic | name | artistic licen | (?:the )?artistic licen[sc]e
bsl-1.0 | tag | identifier bsl | spdx license identifier bsl 1 0
bsl-1.0 | grant | boost software | distributed under the boost software licen[sc]e(?: version 1 0)?
bsl-1.0 | text | executable object code | solely in the form of machine executable object code generated by a source language processor
bsl-1.0 | name | boost software | boost software licen[sc]e(?: (?:version |v )?1 0)?
busl-1.1 | tag | identifier busl | spdx license identifier busl 1 1
busl-1.1 | name | business source | business source licen[sc]e(?: (?:version |v )?1 1)?
sspl-1.0 | tag | identifier sspl | spdx license identifier sspl 1 0
sspl-1.0 | name | server side public | server side public licen[sc]e(?: (?:version |v )?1)?
elastic-2.0 | tag | identifier elastic | spdx license identifier elastic 2 0
elastic-2.0 | name | elastic licen | elastic licen[sc]e(?: (?:version |v )?2(?: 0)?)?
commons-clause | name | commons clause | (?:the )?commons clause(?: licen[sc]e)?(?: condition)?
prosperity | name | prosperity public | prosperity public licen[sc]e
polyform | name | polyform | polyform (?:noncommercial|small business|shield|strict|perimeter|free trial) licen[sc]e
ofl-1.1 | tag | identifier ofl | spdx license identifier ofl 1 1
ofl-1.1 | grant | open font | licen[sc]ed under the sil open font licen[sc]e(?: version 1 1)?
ofl-1.1 | version | open font | (?:sil )?open font licen[sc]e (?:version |v )?1 1
ofl | text | reserved font name | with reserved font name
ofl | name | open font | (?:sil )?open font licen[sc]e
ubuntu-font | name | ubuntu font | ubuntu font licen[sc]e(?: (?:version |v )?1 0)?
bitstream-vera | name | bitstream vera | bitstream vera (?:fonts )?(?:copyright|licen[sc]e)
odbl-1.0 | tag | identifier odbl | spdx license identifier odbl 1 0
odbl-1.0 | grant | open database | (?:licen[sc]ed|released|made available) under the open (?:data commons open )?database licen[sc]e
odbl-1.0 | name | open database | open database licen[sc]e(?: (?:version |v )?1 0)?
odc-by-1.0 | tag | identifier odc | spdx license identifier odc by 1 0
odc-by-1.0 | name | open data commons attribution | open data commons attribution licen[sc]e(?: (?:version |v )?1 0)?
pddl-1.0 | tag | identifier pddl | spdx license identifier pddl 1 0
pddl-1.0 | name | public domain dedication | public domain dedication and licen[sc]e(?: (?:version |v )?1 0)?
cdla-permissive | name | community data | community data licen[sc]e agreement permissive(?: (?:version |v )?[12] 0)?
cdla-sharing | name | community data | community data licen[sc]e agreement sharing(?: (?:version |v )?1 0)?
ogl-3.0 | grant | open government | contains public sector information licen[sc]ed under the open government licen[sc]e v3 0
ogl | name | open government | open government licen[sc]e
openrail | name | openrail | (?:creativeml |bigscience )?openrail(?: m)?(?: licen[sc]e)?
ms-pl | tag | identifier ms pl | spdx license identifier ms pl
ms-rl | tag | identifier ms rl | spdx license identifier ms rl
ms-pl | name | microsoft public | microsoft public licen[sc]e
ms-rl | name | microsoft reciprocal | microsoft reciprocal licen[sc]e
python-2.0 | tag | identifier python | spdx license identifier python 2 0
python-2.0 | tag | identifier psf | spdx license identifier psf 2 0
python | name | python software foundation | python software foundation licen[sc]e(?: (?:version |v )?2)?
php-3.01 | tag | identifier php | spdx license identifier php 3 01
php | name | php licen | (?:the )?php licen[sc]e(?: (?:version |v )?3 01?)?
php | text | includes php software | this product includes php software
ruby | tag | identifier ruby | spdx license identifier ruby
ruby | name | ruby licen | (?:the )?ruby licen[sc]e
postgresql | tag | identifier postgresql | spdx license identifier postgresql
postgresql | name | postgresql licen | (?:the )?postgresql licen[sc]e
openssl | tag | identifier openssl | spdx license identifier openssl
openssl | text | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
openssl | name | openssl licen | (?:the )?openssl licen[sc]e
curl | tag | identifier curl | spdx license identifier curl
ncsa | tag | identifier ncsa | spdx license identifier ncsa
ncsa | name | illinois | university of illinois (?:ncsa )?open source licen[sc]e
w3c | tag | identifier w3c | spdx license identifier w3c
w3c | name | w3c | w3c (?:software )?(?:and document )?(?:notice and )?licen[sc]e
unicode | name | unicode licen | unicode licen[sc]e(?: agreement| v3)?
icu | name | icu licen | (?:the )?icu licen[sc]e
unlicense | tag | identifier unlicense | spdx license identifier unlicense
unlicense | text | unencumbered software | this is free and unencumbered software released into the public domain
unlicense | name | unlicen | (?:the )?unlicen[sc]e
wtfpl | tag | identifier wtfpl | spdx license identifier wtfpl
wtfpl | text | the fuck you want | do what the fuck you want to(?: public licen[sc]e)?
wtfpl | name | wtfpl | wtfpl(?: licen[sc]e)?
beerware | name | beer ware | (?:the )?beer ware licen[sc]e
jsonlicense | text | good not evil | the software shall be used for good not evil
npl-1.1 | name | netscape public | netscape public licen[sc]e(?: (?:version |v )?1 1)?
apsl-2.0 | name | apple public source | apple public source licen[sc]e(?: (?:version |v )?2 0)?
lppl-1.3c | tag | identifier lppl | spdx license identifier lppl 1 3c
lppl | name | latex project public | latex project public licen[sc]e(?: (?:version |v )?1 3c?)?
ldpl | name | linux documentation project | linux documentation project licen[sc]e
upl-1.0 | name | universal permissive | universal permissive licen[sc]e(?: (?:version |v )?1 0)?
vim | name | vim licen | (?:the )?vim licen[sc]e
blueoak-1.0.0 | name | blue oak model | blue oak model licen[sc]e(?: 1 0 0)?
mulan-psl-2.0 | name | mulan | mulan (?:permissive software|psl) licen[sc]e(?: (?:version |v )?2)?
cc0-1.0 | tag | identifier cc0 | spdx license identifier cc0 1 0
cc-by-4.0 | tag | identifier cc by | spdx license identifier cc by 4 0
cc-by-sa-4.0 | tag | identifier cc by sa | spdx license identifier cc by sa 4 0
cc-by-nc-4.0 | tag | identifier cc by nc | spdx license identifier cc by nc 4 0
cc-by-nd-4.0 | tag | identifier cc by nd | spdx license identifier cc by nd 4 0
cc-by-nc-sa-4.0 | tag | identifier cc by nc | spdx license identifier cc by nc sa 4 0
cc-by-nc-nd-4.0 | tag | identifier cc by nc | spdx license identifier cc by nc nd 4 0
cc-by-3.0 | tag | identifier cc by | spdx license identifier cc by 3 0
cc-by-sa-3.0 | tag | identifier cc by sa | spdx license identifier cc by sa 3 0
cc0-1.0 | grant | publicdomain zero | creativecommons org publicdomain zero 1 0
cc0 | text | waived all copyright | (?:has|have) waived all copyright and related (?:or|and) neighboring rights
cc0-1.0 | version | cc0 1 0 | cc0 1 0(?: universal)?
cc0 | name | creative commons zero | creative commons zero
cc0 | name | cc0 | cc0
cc-by-4.0 | grant | licenses by 4 | creativecommons org licenses by 4 0
cc-by-3.0 | grant | licenses by 3 | creativecommons org licenses by 3 0
cc-by-sa-4.0 | grant | licenses by sa 4 | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | grant | licenses by sa 3 | creativecommons org licenses by sa 3 0
cc-by-nc-4.0 | grant | licenses by nc 4 | creativecommons org licenses by nc 4 0
cc-by-nc-sa-4.0 | grant | licenses by nc sa 4 | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | grant | licenses by nc nd 4 | creativecommons org licenses by nc nd 4 0
cc-by-nd-4.0 | grant | licenses by nd 4 | creativecommons org licenses by nd 4 0
cc-by-4.0 | grant | creative commons attribution | (?:licen[sc]ed|released|available|distributed) under (?:a |the )?creative commons attribution 4 0(?: international)?(?: licen[sc]e)?
cc-by-sa-4.0 | grant | creative commons attribution | (?:licen[sc]ed|released|available|distributed) under (?:a |the )?creative commons attribution share ?alike 4 0(?: international)?(?: licen[sc]e)?
cc-by-sa-3.0 | grant | creative commons attribution | (?:licen[sc]ed|released|available|distributed) under (?:a |the )?creative commons attribution share ?alike 3 0(?: unported)?(?: licen[sc]e)?
cc-by-sa | grant | cc by sa | (?:licen[sc]ed|released|available|distributed) under (?:a |the )?cc by sa(?: licen[sc]e)?
cc-by | grant | cc by | (?:licen[sc]ed|released|available|distributed) under (?:a |the )?cc by(?: licen[sc]e)?
cc-by-nc-nd-4.0 | version | cc by nc nd | cc by nc nd 4 0(?: international)?
cc-by-nc-nd-3.0 | version | cc by nc nd | cc by nc nd 3 0(?: unported)?
cc-by-nc-sa-4.0 | version | cc by nc sa | cc by nc sa 4 0(?: international)?
cc-by-nc-sa-3.0 | version | cc by nc sa | cc by nc sa 3 0(?: unported)?
cc-by-nc-4.0 | version | cc by nc | cc by nc 4 0(?: international)?
cc-by-nc-3.0 | version | cc by nc | cc by nc 3 0(?: unported)?
cc-by-nd-4.0 | version | cc by nd | cc by nd 4 0(?: international)?
cc-by-nd-3.0 | version | cc by nd | cc by nd 3 0(?: unported)?
cc-by-sa-4.0 | version | cc by sa | cc by sa 4 0(?: international)?
cc-by-sa-3.0 | version | cc by sa | cc by sa 3 0(?: unported)?
cc-by-sa-2.5 | version | cc by sa | cc by sa 2 5
cc-by-sa-2.0 | version | cc by sa | cc by sa 2 0
cc-by-4.0 | version | cc by 4 | cc by 4 0(?: international)?
cc-by-3.0 | version | cc by 3 | cc by 3 0(?: unported)?
cc-by-2.5 | version | cc by 2 | cc by 2 5
cc-by-2.0 | version | cc by 2 | cc by 2 0
cc-by-4.0 | version | creative commons attribution | creative commons attribution 4 0(?: international)?
cc-by-3.0 | version | creative commons attribution | creative commons attribution 3 0(?: unported)?
cc-by-sa-4.0 | version | creative commons attribution | creative commons attribution share ?alike 4 0(?: international)?
cc-by-sa-3.0 | version | creative commons attribution | creative commons attribution share ?alike 3 0(?: unported)?
cc-by-nc-nd | name | cc by nc nd | cc by nc nd
cc-by-nc-sa | name | cc by nc sa | cc by nc sa
cc-by-nc | name | cc by nc | cc by nc
cc-by-nd | name | cc by nd | cc by nd
cc-by-sa | name | cc by sa | cc by sa
cc-by-nc-nd | name | creative commons attribution | creative commons attribution non ?commercial no ?deriv(?:ative|ativework)?s
cc-by-nc-sa | name | creative commons attribution | creative commons attribution non ?commercial share ?alike
cc-by-nc | name | creative commons attribution | creative commons attribution non ?commercial
cc-by-nd | name | creative commons attribution | creative commons attribution no ?deriv(?:ative|ativework)?s
cc-by-sa | name | creative commons attribution | creative commons attribution share ?alike
cc-by | name | creative commons attribution | creative commons attribution
creative-commons | hint | creative commons | creative commons(?: licen[sc]e)?
public-domain | text | the public domain | (?:placed|released|dedicated) (?:in|into|to) the public domain
public-domain | hint | public domain | (?:in|into|to) the public domain
copyleft | hint | copyleft | copyleft
all-rights-reserved | hint | all rights reserved | all rights reserved
copyright | hint | copyright | copyright(?: c)? (?:19|20)[0-9]{2}
proprietary | text | proprietary and confidential | (?:this (?:software|file|document) is )?proprietary and confidential
proprietary | text | unauthorized copying | unauthorized copying of this file via any medium is strictly prohibited
proprietary | name | end user licen | end user licen[sc]e agreement
proprietary | hint | prior written | (?:may not be|no part of .{1,60}? may be) (?:copied|reproduced) .{0,60}?without (?:the )?prior written (?:permission|consent)
"""

#: A text with none of these has no detection: each rule's keyword holds one of them.
GATES = ("licen", "gpl", " identifier ", "general public", "free software", "hope that it", "should have received", "designed to take away", "classpath exception", "library exception", "library general", "lesser general", "affero general", "invariant sections", "apache", "except in compliance", "as is basis", "terms and conditions for use", "hereby granted", "above copyright notice", "without warranty of any", "x consortium", " bsd ", "clause", "source and binary forms", "redistributions", "endorse or promote", "advertising materials", "permission to use", "zlib", "altered source", "must not be misrepresented", "mozilla public", "mpl was not distributed", "mpl 1 1", "mpl 2 0", "eclipse ", "common public", "ibm public", "common development", "european union public", "under the eupl", "cecill", "open software", "academic free", "educational community", "same terms as perl", "boost software", "executable object code", "business source", "server side public", "prosperity public", "polyform", "open font", "reserved", "ubuntu font", "bitstream vera", "open data", "public domain", "publicdomain zero", "community data", "open government", "openrail", "microsoft ", "python software foundation", "includes php software", "openssl toolkit", "illinois", "w3c", "unencumbered software", "the fuck you want", "wtfpl", "beer ware", "good not evil", "netscape public", "apple public source", "latex project public", "linux documentation project", "universal permissive", "blue oak model", "mulan", "waived all copyright", "cc0", "creative commons", "cc by", "copyleft", "copyright", "proprietary and confidential", "unauthorized copying", "prior written")


def rules() -> list[Rule]:
    out = []
    for line in SIGNATURES.strip().splitlines():
        label, kind, keyword, pattern = line.split(" | ")
        out.append(Rule(label, *KINDS[kind], keyword, pattern))
    return out
