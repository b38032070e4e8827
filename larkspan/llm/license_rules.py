"""Signature rules of licences, written by hand.

A rule stands on one line: label | keyword | pattern.  Patterns run over words
in small letters that one space parts (so "GPL-2.0" is "gpl 2 0"); they begin
and end at whole words.  A text that does not hold the keyword is not searched.
Rules are ordered: by the section they stand in, then by line.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    number: int
    level: int
    label: str
    keyword: str
    pattern: str


#: What a detection of each level is worth for the score, from 1 (a tag) to 7 (a hint).
WORTH = (0.99, 0.97, 0.9, 0.8, 0.6, 0.75, 0.3)

# Tags: an identifier that is declared as such.
_TAGS = r"""
gpl-1.0-only | spdx | spdx license identifier gpl 1 0(?: only)?(?! or later)
gpl-1.0-or-later | spdx | spdx license identifier gpl 1 0 or later
gpl-2.0-only | spdx | spdx license identifier gpl 2 0(?: only)?(?! or later)
gpl-2.0-or-later | spdx | spdx license identifier gpl 2 0 or later
gpl-3.0-only | spdx | spdx license identifier gpl 3 0(?: only)?(?! or later)
gpl-3.0-or-later | spdx | spdx license identifier gpl 3 0 or later
lgpl-2.0-only | spdx | spdx license identifier lgpl 2 0(?: only)?(?! or later)
lgpl-2.1-only | spdx | spdx license identifier lgpl 2 1(?: only)?(?! or later)
lgpl-2.1-or-later | spdx | spdx license identifier lgpl 2 1 or later
lgpl-3.0-only | spdx | spdx license identifier lgpl 3 0(?: only)?(?! or later)
lgpl-3.0-or-later | spdx | spdx license identifier lgpl 3 0 or later
agpl-3.0-only | spdx | spdx license identifier agpl 3 0(?: only)?(?! or later)
agpl-3.0-or-later | spdx | spdx license identifier agpl 3 0 or later
gfdl-1.3 | spdx | spdx license identifier gfdl 1 3(?: only| or later)?
apache-1.1 | spdx | spdx license identifier apache 1 1
apache-2.0 | spdx | spdx license identifier apache 2 0
mit-0 | spdx | spdx license identifier mit 0
mit | spdx | spdx license identifier mit(?! 0)
x11 | spdx | spdx license identifier x11
isc | spdx | spdx license identifier isc
0bsd | spdx | spdx license identifier 0bsd
bsd-2-clause | spdx | spdx license identifier bsd 2 clause
bsd-3-clause-clear | spdx | spdx license identifier bsd 3 clause clear
bsd-3-clause | spdx | spdx license identifier bsd 3 clause(?! clear)
bsd-4-clause | spdx | spdx license identifier bsd 4 clause
mpl-1.1 | spdx | spdx license identifier mpl 1 1
mpl-2.0 | spdx | spdx license identifier mpl 2 0(?: no copyleft exception)?
epl-1.0 | spdx | spdx license identifier epl 1 0
epl-2.0 | spdx | spdx license identifier epl 2 0
eupl-1.2 | spdx | spdx license identifier eupl 1 2
cddl-1.0 | spdx | spdx license identifier cddl 1 [01]
bsl-1.0 | spdx | spdx license identifier bsl 1 0
zlib | spdx | spdx license identifier zlib(?: acknowledgement)?
unlicense | spdx | spdx license identifier unlicense
wtfpl | spdx | spdx license identifier wtfpl
cc0-1.0 | spdx | spdx license identifier cc0 1 0
cc-by-4.0 | spdx | spdx license identifier cc by 4 0
cc-by-sa-4.0 | spdx | spdx license identifier cc by sa 4 0
cc-by-nc-4.0 | spdx | spdx license identifier cc by nc 4 0
cc-by-nc-sa-4.0 | spdx | spdx license identifier cc by nc sa 4 0
cc-by-nd-4.0 | spdx | spdx license identifier cc by nd 4 0
ofl-1.1 | spdx | spdx license identifier ofl 1 1(?: no rfn| rfn)?
artistic-2.0 | spdx | spdx license identifier artistic 2 0
python-2.0 | spdx | spdx license identifier (?:python|psf) 2 0
busl-1.1 | spdx | spdx license identifier busl 1 1
sspl-1.0 | spdx | spdx license identifier sspl 1 0
blueoak-1.0.0 | spdx | spdx license identifier blueoak 1 0 0
mulanpsl-2.0 | spdx | spdx license identifier mulanpsl 2 0
proprietary | spdx | spdx license identifier (?:licenseref proprietary|none)
"""

# Sentences of licence texts.
_BODIES = r"""
mit | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit-0 | permission | without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
mit | software is provided | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
isc | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
0bsd | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)
hpnd | permission | permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display
bsd-3-clause | endorse | neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products
bsd-2-clause | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-2-clause | redistributions | redistributions of source code must retain the above copyright notice
bsd-2-clause | redistributions | redistributions in binary form must reproduce the above copyright notice
apache-2.0 | apache | you may not use this file except in compliance with the license you may obtain a copy of the license at(?: https?)? www apache org licenses license 2 0
apache-2.0 | derivative works | grant of copyright license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-1.1 | apache | products derived from this software may not be called apache
gpl-2.0-or-later | general public | free software foundation either version 2 of the license or (?:at your option )?any later version
gpl-3.0-or-later | general public | free software foundation either version 3 of the license or (?:at your option )?any later version
gpl | general public | you can redistribute it and or modify it under the terms of the gnu general public license
lgpl | general public | you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
agpl | affero | you can redistribute it and or modify it under the terms of the gnu affero general public license
gpl | warranty | this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
gpl-2.0 | licenses for most | the licenses for most software are designed to take away your freedom to share and change it
gpl-3.0 | copyleft | the gnu general public license is a free copyleft license for software and other kinds of works
lgpl-2.1 | general public | this license the lesser general public license applies to some specially designated software packages
agpl-3.0 | affero | the gnu affero general public license is a free copyleft license
gfdl | documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
epl | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license
cddl-1.0 | development and distribution | the contents of this file are subject to the terms of the common development and distribution license
cpl-1.0 | common public | the accompanying program is provided under the terms of this common public license
bsl-1.0 | boost | distributed under the boost software license version 1 0
zlib | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | altered source | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
unlicense | public domain | this is free and unencumbered software released into the public domain
cc0-1.0 | public domain | to the extent possible under law .{1,80}? (?:has|have) waived all copyright and related or neighboring rights
wtfpl | what the | you just do what the fuck you want to
ofl-1.1 | open font | this font software is licensed under the sil open font license version 1 1
artistic | artistic | you may redistribute it and or modify it under the same terms as perl
ms-pl | microsoft | this license governs use of the accompanying software if you use the software you accept this license
python-2.0 | python | psf is making python available to licensee on an as is basis
openssl | openssl | this product includes software developed by the openssl project
php-3.01 | php | this product includes php software freely available from
json | good not evil | the software shall be used for good not evil
beerware | beer | if we meet some day and you think this stuff is worth it you can buy me a beer
postgresql | postgres | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
busl-1.1 | change date | effective on the change date or the fourth anniversary of the first publicly available distribution
sspl-1.0 | service source | making the service source code available
elastic-2.0 | hosted or managed | you may not provide the software to third parties as a hosted or managed service
commons-clause | commons clause | the license does not grant to you the right to sell the software
"""

# Notices that name the licence they put a work under.
_NOTICES = r"""
apache-2.0 | apache | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?apache (?:software )?(?:public )?license (?:version |v ?)?2(?: 0)?
apache-1.1 | apache | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?apache (?:software )?license (?:version |v ?)?1 1
apache | apache | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?apache(?: software)?(?: license)?
mit | mit | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?(?:mit|expat|mit x11|x11 mit)(?: open source| style)? licen[cs]e
mit | mit | (?:this|the) (?:project|software|code|library|package) is (?:mit licensed|under the mit licen[cs]e)
gpl-1.0 | gnu | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[cs]e (?:version |v ?)1(?: 0)?
gpl-2.0-or-later | gnu | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[cs]e (?:version |v ?)2(?: 0)? or (?:any )?later(?: version)?
gpl-3.0-or-later | gnu | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[cs]e (?:version |v ?)3(?: 0)? or (?:any )?later(?: version)?
gpl-2.0 | gnu | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[cs]e (?:version |v ?)2(?: 0)?
gpl-3.0 | gnu | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[cs]e (?:version |v ?)3(?: 0)?
gpl | gnu | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[cs]e
lgpl-2.1 | gnu | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?gnu lesser general public licen[cs]e (?:version |v ?)2 1
lgpl-3.0 | gnu | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?gnu lesser general public licen[cs]e (?:version |v ?)3(?: 0)?
lgpl | gnu | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?gnu (?:lesser|library) general public licen[cs]e
agpl-3.0 | affero | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?affero general public licen[cs]e(?: (?:version |v ?)3(?: 0)?)?
gpl | gpl | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl(?:v[123])?
lgpl | lgpl | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lgpl(?:v[23])?
bsd-2-clause | bsd | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?(?:2 clause|simplified|freebsd) bsd licen[cs]e
bsd-3-clause | bsd | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?(?:3 clause|new|modified|revised) bsd licen[cs]e
bsd | bsd | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?bsd(?: style)?(?: licen[cs]e)?
mpl-2.0 | mozilla | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?mozilla public licen[cs]e (?:version |v ?)?2(?: 0)?
mpl | mozilla | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?mozilla public licen[cs]e
epl-2.0 | eclipse | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?eclipse public licen[cs]e (?:version |v ?)?2(?: 0)?
epl | eclipse | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?eclipse public licen[cs]e
cc-by-4.0 | cc by | (?:licensed|released|distributed|available|published|shared) under (?:the )?(?:a )?cc by 4 0
cc-by-3.0 | cc by | (?:licensed|released|distributed|available|published|shared) under (?:the )?(?:a )?cc by 3 0
cc-by-sa-4.0 | cc by sa | (?:licensed|released|distributed|available|published|shared) under (?:the )?(?:a )?cc by sa 4 0
cc-by-sa-3.0 | cc by sa | (?:licensed|released|distributed|available|published|shared) under (?:the )?(?:a )?cc by sa 3 0
cc-by-nc-4.0 | cc by nc | (?:licensed|released|distributed|available|published|shared) under (?:the )?(?:a )?cc by nc 4 0
cc-by-nc-3.0 | cc by nc | (?:licensed|released|distributed|available|published|shared) under (?:the )?(?:a )?cc by nc 3 0
cc-by-nc-sa-4.0 | cc by nc sa | (?:licensed|released|distributed|available|published|shared) under (?:the )?(?:a )?cc by nc sa 4 0
cc-by-nc-nd-4.0 | cc by nc nd | (?:licensed|released|distributed|available|published|shared) under (?:the )?(?:a )?cc by nc nd 4 0
cc-by-nd-4.0 | cc by nd | (?:licensed|released|distributed|available|published|shared) under (?:the )?(?:a )?cc by nd 4 0
cc0-1.0 | cc0 | (?:licensed|released|dedicated|available|published|shared) (?:under|to|into) (?:the )?(?:public domain )?(?:using )?cc0(?: 1 0)?
cc-by | creative commons | (?:licensed|released|available|published|shared) under (?:a |the )?creative commons attribution(?: \d 0)?(?: international| unported| generic)?(?: public)? licen[cs]e
cc-by-sa | creative commons | (?:licensed|released|available|published|shared) under (?:a |the )?creative commons attribution share ?alike(?: \d 0)?(?: international| unported)?(?: public)? licen[cs]e
cc-by-nc | creative commons | (?:licensed|released|available|published|shared) under (?:a |the )?creative commons attribution non ?commercial(?: \d 0)?(?: international| unported)?(?: public)? licen[cs]e
isc | isc | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?isc licen[cs]e
zlib | zlib | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?zlib(?: libpng)? licen[cs]e
unlicense | unlicense | (?:licensed|released|distributed|available|provided) under (?:the )?unlicense
public-domain | public domain | (?:placed|released|dedicated|put) (?:in|into|to) the public domain
proprietary | proprietary | (?:licensed|released|distributed|available|provided) under (?:a |the )?(?:commercial|proprietary) licen[cs]e
dual-mit-apache | apache | (?:licensed|available|released) under either (?:of )?(?:the )?(?:apache .{1,40}? mit|mit .{1,40}? apache)
"""

# Names with a version.
_VERSIONS = r"""
apache-1.0 | apache | apache (?:software )?licen[cs]e (?:version |v ?)?1 0
apache-1.1 | apache | apache (?:software )?licen[cs]e (?:version |v ?)?1 1
apache-2.0 | apache | apache (?:software )?(?:public )?licen[cs]e (?:version |v ?)?2(?: 0)?
apache-2.0 | apache | apache (?:v ?)?2 0
gpl-1.0 | gnu general | gnu general public licen[cs]e (?:version |v ?)?1(?: 0)?
gpl-2.0 | gnu general | gnu general public licen[cs]e (?:version |v ?)?2(?: 0)?
gpl-3.0 | gnu general | gnu general public licen[cs]e (?:version |v ?)?3(?: 0)?
gpl-2.0 | gpl | (?:gnu )?gpl ?(?:version |v ?)?2(?: 0)?
gpl-3.0 | gpl | (?:gnu )?gpl ?(?:version |v ?)?3(?: 0)?
lgpl-2.0 | library general | gnu library general public licen[cs]e (?:version |v ?)?2(?: 0)?
lgpl-2.1 | lesser general | gnu lesser general public licen[cs]e (?:version |v ?)?2 1
lgpl-3.0 | lesser general | gnu lesser general public licen[cs]e (?:version |v ?)?3(?: 0)?
lgpl-2.1 | lgpl | lgpl ?(?:version |v ?)?2 1
lgpl-3.0 | lgpl | lgpl ?(?:version |v ?)?3(?: 0)?
agpl-3.0 | affero | (?:gnu )?affero general public licen[cs]e (?:version |v ?)?3(?: 0)?
agpl-3.0 | agpl | agpl ?(?:version |v ?)?3(?: 0)?
gfdl-1.2 | free documentation | gnu free documentation licen[cs]e (?:version |v ?)?1 2
gfdl-1.3 | free documentation | gnu free documentation licen[cs]e (?:version |v ?)?1 3
bsd-2-clause | bsd | (?:2 clause|two clause|simplified|freebsd) bsd(?: style)? licen[cs]e
bsd-2-clause | bsd | bsd 2 clause(?: licen[cs]e)?
bsd-3-clause | bsd | (?:3 clause|three clause|new|modified|revised) bsd(?: style)? licen[cs]e
bsd-3-clause | bsd | bsd 3 clause(?: licen[cs]e)?
bsd-4-clause | bsd | (?:4 clause|four clause|original|old) bsd(?: style)? licen[cs]e
bsd-4-clause | bsd | bsd 4 clause(?: licen[cs]e)?
mpl-1.0 | mozilla | mozilla public licen[cs]e (?:version |v ?)?1 0
mpl-1.1 | mozilla | mozilla public licen[cs]e (?:version |v ?)?1 1
mpl-2.0 | mozilla | mozilla public licen[cs]e (?:version |v ?)?2(?: 0)?
mpl-2.0 | mpl | mpl ?(?:version |v ?)?2(?: 0)?
epl-1.0 | eclipse | eclipse public licen[cs]e (?:version |v ?)?1(?: 0)?
epl-2.0 | eclipse | eclipse public licen[cs]e (?:version |v ?)?2(?: 0)?
eupl-1.1 | european union | european union public licen[cs]e (?:version |v ?)?1 1
eupl-1.2 | european union | european union public licen[cs]e (?:version |v ?)?1 2
cddl-1.0 | development and distribution | common development and distribution licen[cs]e (?:cddl )?(?:version |v ?)?1 0
cddl-1.1 | development and distribution | common development and distribution licen[cs]e (?:cddl )?(?:version |v ?)?1 1
bsl-1.0 | boost | boost software licen[cs]e (?:version |v ?)?1 0
afl-3.0 | academic free | academic free licen[cs]e (?:version |v ?)?3 0
osl-3.0 | open software | open software licen[cs]e (?:version |v ?)?3 0
artistic-1.0 | artistic | artistic licen[cs]e (?:version |v ?)?1 0
artistic-2.0 | artistic | artistic licen[cs]e (?:version |v ?)?2 0
ofl-1.1 | open font | (?:sil )?open font licen[cs]e (?:version |v ?)?1 1
cc-by-1.0 | cc by | cc by 1 0
cc-by-2.0 | cc by | cc by 2 0
cc-by-2.5 | cc by | cc by 2 5
cc-by-3.0 | cc by | cc by 3 0
cc-by-4.0 | cc by | cc by 4 0
cc-by-sa-2.0 | cc by sa | cc by sa 2 0
cc-by-sa-3.0 | cc by sa | cc by sa 3 0
cc-by-sa-4.0 | cc by sa | cc by sa 4 0
cc-by-nc-2.0 | cc by nc | cc by nc 2 0
cc-by-nc-3.0 | cc by nc | cc by nc 3 0
cc-by-nc-4.0 | cc by nc | cc by nc 4 0
cc-by-nc-sa-3.0 | cc by nc sa | cc by nc sa 3 0
cc-by-nc-sa-4.0 | cc by nc sa | cc by nc sa 4 0
cc-by-nc-nd-3.0 | cc by nc nd | cc by nc nd 3 0
cc-by-nc-nd-4.0 | cc by nc nd | cc by nc nd 4 0
cc-by-nd-3.0 | cc by nd | cc by nd 3 0
cc-by-nd-4.0 | cc by nd | cc by nd 4 0
cc0-1.0 | cc0 | cc0 1 0
cc-by-4.0 | creative commons | creative commons attribution 4 0(?: international)?
cc-by-3.0 | creative commons | creative commons attribution 3 0(?: unported)?
cc-by-sa-4.0 | creative commons | creative commons attribution share ?alike 4 0(?: international)?
cc-by-sa-3.0 | creative commons | creative commons attribution share ?alike 3 0(?: unported)?
cc-by-nc-4.0 | creative commons | creative commons attribution non ?commercial 4 0(?: international)?
cc-by-nc-sa-4.0 | creative commons | creative commons attribution non ?commercial share ?alike 4 0(?: international)?
cc-by-nc-nd-4.0 | creative commons | creative commons attribution non ?commercial no ?deriv(?:s|atives) 4 0(?: international)?
php-3.01 | php | php licen[cs]e (?:version |v ?)?3 01
zpl-2.1 | zope | zope public licen[cs]e (?:version |v ?)?2 1
lppl-1.3c | latex | latex project public licen[cs]e (?:version |v ?)?1 3c?
python-2.0 | python | python (?:software foundation )?licen[cs]e (?:version |v ?)?2(?: 0)?
busl-1.1 | business source | business source licen[cs]e (?:version |v ?)?1 1
sspl-1.0 | server side | server side public licen[cs]e (?:version |v ?)?1(?: 0)?
elastic-2.0 | elastic | elastic licen[cs]e (?:version |v ?)?2(?: 0)?
mulanpsl-2.0 | mulan | mulan (?:permissive software|psl) licen[cs]e (?:version |v ?)?2
odbl-1.0 | database | open (?:data commons open )?database licen[cs]e (?:odbl )?(?:version |v ?)?1 0
"""

# Names.
_NAMES = r"""
apache | apache | apache (?:software )?(?:public )?licen[cs]e
mit | mit | (?:mit|expat|x11) (?:open source )?licen[cs]e
mit | mit | mit licensed
gpl | gnu general | gnu general public licen[cs]e
gpl | gpl | gpl(?:v\d)?(?: licen[cs]ed?)?
lgpl | general public | gnu (?:lesser|library) general public licen[cs]e
lgpl | lgpl | lgpl(?:v\d)?(?: licen[cs]ed?)?
agpl | affero | (?:gnu )?affero general public licen[cs]e
agpl | agpl | agpl(?:v\d)?(?: licen[cs]ed?)?
gfdl | free documentation | gnu free documentation licen[cs]e
bsd | bsd | bsd(?: style)? licen[cs]ed?
isc | isc | isc licen[cs]e
mpl | mozilla | mozilla public licen[cs]e
epl | eclipse | eclipse public licen[cs]e
eupl | european union | european union public licen[cs]e
cddl | development and distribution | common development and distribution licen[cs]e
cpl | common public | common public licen[cs]e
ipl | ibm public | ibm public licen[cs]e
bsl-1.0 | boost | boost software licen[cs]e
zlib | zlib | zlib(?: libpng)? licen[cs]e
unlicense | unlicense | the unlicense
wtfpl | wtfpl | wtfpl
wtfpl | what the | do what the fuck you want to public licen[cs]e
artistic | artistic | (?:perl )?artistic licen[cs]e
ofl | open font | (?:sil )?open font licen[cs]e
cc-by | creative commons | creative commons attribution(?! (?:share|non|no))
cc-by-sa | creative commons | creative commons attribution share ?alike
cc-by-nc | creative commons | creative commons attribution non ?commercial(?! (?:share|no))
cc-by-nc-sa | creative commons | creative commons attribution non ?commercial share ?alike
cc-by-nc-nd | creative commons | creative commons attribution non ?commercial no ?deriv(?:s|atives)
cc-by-nd | creative commons | creative commons attribution no ?deriv(?:s|atives)
cc-by-nc-sa | cc by nc sa | cc by nc sa
cc-by-nc-nd | cc by nc nd | cc by nc nd
cc-by-nc | cc by nc | cc by nc(?! (?:sa|nd))
cc-by-sa | cc by sa | cc by sa
cc-by-nd | cc by nd | cc by nd
cc0 | cc0 | cc0
public-domain | public domain | public domain
python | python | python (?:software foundation )?licen[cs]e
ruby | ruby | ruby licen[cs]e
php | php | php licen[cs]e
zpl | zope | zope public licen[cs]e
w3c | w3c | w3c software (?:notice and )?licen[cs]e
ncsa | ncsa | (?:university of illinois )?ncsa open source licen[cs]e
postgresql | postgresql | postgresql licen[cs]e
openssl | openssl | openssl licen[cs]e
ms-pl | microsoft | microsoft public licen[cs]e
ms-rl | microsoft | microsoft reciprocal licen[cs]e
ijg | jpeg | independent jpeg group licen[cs]e
vim | vim | vim licen[cs]e
beerware | beerware | beerware licen[cs]e
afl | academic free | academic free licen[cs]e
osl | open software | open software licen[cs]e
busl | business source | business source licen[cs]e
sspl | server side | server side public licen[cs]e
elastic | elastic | elastic licen[cs]e
commons-clause | commons clause | commons clause
odbl | database | open database licen[cs]e
openrail | openrail | (?:creativeml |bigcode |bigscience )?openrail(?: [ms])?(?: licen[cs]e)?
"""

# Addresses.
_ADDRESSES = r"""
apache-2.0 | apache | apache org licenses license 2 0(?: txt| html)?
apache-1.1 | apache | apache org licenses license 1 1
mit | opensource | opensource org licenses mit(?: license)?(?: php| html)?
bsd-2-clause | opensource | opensource org licenses bsd 2 clause
bsd-3-clause | opensource | opensource org licenses bsd 3 clause
isc | opensource | opensource org licenses isc
artistic-2.0 | opensource | opensource org licenses artistic 2 0
gpl-2.0 | gnu | gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
gpl-3.0 | gnu | gnu org licenses gpl 3 0(?: html| txt)?
gpl | gnu | gnu org licenses gpl(?: html| txt)?
lgpl-2.1 | gnu | gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?
lgpl-3.0 | gnu | gnu org licenses lgpl 3 0(?: html| txt)?
agpl-3.0 | gnu | gnu org licenses agpl 3 0(?: html| txt)?
gfdl | gnu | gnu org licenses fdl(?: 1 [123])?(?: html| txt)?
mpl-2.0 | mozilla | mozilla org mpl 2 0
mpl-1.1 | mozilla | mozilla org mpl mpl 1 1(?: html)?
epl-2.0 | eclipse | eclipse org (?:legal|org documents) epl 2 0
epl-1.0 | eclipse | eclipse org (?:legal|org documents) epl v10(?: html)?
bsl-1.0 | boost | boost org license 1 0(?: txt)?
unlicense | unlicense | unlicense org
wtfpl | wtfpl | wtfpl net
cc0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
public-domain | creativecommons | creativecommons org publicdomain mark 1 0
cc-by-4.0 | creativecommons | creativecommons org licenses by 4 0
cc-by-3.0 | creativecommons | creativecommons org licenses by 3 0
cc-by-sa-4.0 | creativecommons | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | creativecommons | creativecommons org licenses by sa 3 0
cc-by-nc-4.0 | creativecommons | creativecommons org licenses by nc 4 0
cc-by-nc-3.0 | creativecommons | creativecommons org licenses by nc 3 0
cc-by-nc-sa-4.0 | creativecommons | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | creativecommons | creativecommons org licenses by nc nd 4 0
cc-by-nd-4.0 | creativecommons | creativecommons org licenses by nd 4 0
ofl-1.1 | scripts sil | scripts sil org ofl
odbl-1.0 | opendatacommons | opendatacommons org licenses odbl(?: 1 0)?
"""

# Hints: that there are terms, not which.
_HINTS = r"""
all-rights-reserved | rights reserved | all rights reserved
unknown-license | licensed under | licensed under (?:the )?(?:terms of (?:the )?)?(?:[^ ]+ ){1,6}?licen[cs]e
unknown-license | license agreement | (?:end user|software) license agreement
unknown-license | see license | see (?:the )?license (?:file|txt|md)
unknown-license | license file | see the (?:accompanying |included )?license file
unknown-license | license identifier | spdx license identifier [^ ]+
copyright | copyright | copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)*
proprietary | confidential | (?:proprietary and confidential|confidential and proprietary)
proprietary | may not be | may not be (?:reproduced|redistributed|copied) without (?:the )?(?:prior )?(?:written )?(?:permission|consent)
non-commercial | commercial use | for non ?commercial use only
research-only | research | for research (?:use|purposes) only
"""


def _read() -> tuple[Rule, ...]:
    rows = []
    for level, section in enumerate((_TAGS, _BODIES, _NOTICES, _VERSIONS, _NAMES, _ADDRESSES, _HINTS), 1):
        for line in section.strip().splitlines():
            label, keyword, pattern = line.split(" | ", 2)
            rows.append(Rule(len(rows), level, label, keyword, pattern))
    return tuple(rows)


RULES = _read()
