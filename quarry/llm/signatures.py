"""License signatures: fixed values, written by hand, in order of priority.

A section names its gate, words of which a text must hold one for the section to be looked at. A
line is ``label: pattern``, a regex over lower-case words with one blank between them (signs part
words, so "2.0" is ``2 0``). Longer names stand before shorter ones of the same kind. Repetitions
are possessive or bounded, so that no text makes the matcher recurse.
"""

RULES = r"""
[spdx]
spdx-apache-2.0: spdx license identifier apache 2 0
spdx-mit: spdx license identifier mit(?: 0)?
spdx-bsd: spdx license identifier (?:0bsd|bsd [1-4] clause(?: clear| patent)?)
spdx-gpl: spdx license identifier gpl [1-3] 0(?: only| or later)?(?: with [a-z0-9]+ exception(?: [0-9] [0-9])?)?
spdx-lgpl: spdx license identifier lgpl [23] [01](?: only| or later)?
spdx-agpl: spdx license identifier agpl 3 0(?: only| or later)?
spdx-mpl: spdx license identifier mpl [12] [01]
spdx-cc: spdx license identifier (?:cc0 1 0|cc by(?: sa| nc| nd){0,3} [1-4] [05])
spdx-isc: spdx license identifier isc
spdx-other: spdx license identifier
spdx-filetext: spdx filecopyrighttext

[apache asl]
apache-2.0: licensed under the apache license version 2 0 the license
apache-2.0: you may obtain a copy of the license at http www apache org licenses license 2 0
apache-2.0: (?:the )?apache (?:software )?license v?(?:ersion )?2(?: 0)?
apache-2.0: apache license version 2 0 january 2004
apache-2.0: apache 2(?: 0)?(?: licensed?)?
apache-2.0: asl 2 0
apache-2.0: apache license 2 0 with llvm exceptions?
apache-1.1: (?:the )?apache software license v?(?:ersion )?1 1
apache-1.0: (?:the )?apache (?:group )?(?:software )?license v?(?:ersion )?1 0
apache-notice: this product includes software developed by the apache (?:software foundation|group)
apache-notice: redistributions of any form whatsoever must retain the following acknowledgment this product includes software developed by the apache
apache: (?:the )?apache (?:software )?licen[sc]e
apache: apache style licen[sc]e

[mit expat x11]
mit-0: mit no attribution(?: license)?
mit-x11: mit x11(?: license)?
mit-x11: x11 mit(?: style)? license
mit: (?:released|licensed|distributed|available) under the (?:terms of the )?mit license
mit: the mit license mit
mit: permissive mit license
mit: (?:the )?mit licen[sc]e
mit: mit licensed
mit: mit style license
mit: (?:the )?expat license
x11: (?:the )?x11 license
x11: x consortium license

[permission]
mit-text: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit-text: permission is hereby granted free of charge to any person obtaining a copy
isc-text: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc-text: permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
hpnd-text: permission to use copy modify (?:and )?distribute(?: and sell)? this software and its documentation for any purpose
boost-text: permission is hereby granted free of charge to any person or organization obtaining a copy of the software
zlib-text: permission is granted to anyone to use this software for any purpose including commercial applications
gfdl-text: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
permission: permission is hereby granted(?: free of charge)?
permission: no part of this (?:publication|book|document|work) may be reproduced
permission: without (?:the )?(?:prior |express |specific )?(?:prior )?written permission(?: of the (?:publisher|author|copyright (?:owner|holder)s?))?
permission: reproduced (?:here )?(?:by|with) permission
permission: used (?:by|with) permission

[redistribution redistributions endorse]
bsd-text: redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-text: redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-text: redistributions in binary form must reproduce the above copyright notice
bsd-text: may be used to endorse or promote products derived from this software
redistribution: redistribution and use in source and binary forms
redistribution: redistributions (?:of source code|in binary form) must
redistribution: redistribution (?:is )?(?:not |strictly )?(?:permitted|prohibited|allowed)

[bsd]
bsd-4-clause: bsd 4 clause(?: license)?
bsd-4-clause: (?:4|four) clause bsd(?: license)?
bsd-4-clause: original bsd license
bsd-3-clause: bsd 3 clause(?: (?:new|revised|clear))?(?: license)?
bsd-3-clause: (?:3|three) clause bsd(?: license)?
bsd-3-clause: (?:new|revised|modified) bsd license
bsd-2-clause: bsd 2 clause(?: (?:simplified|patent))?(?: license)?
bsd-2-clause: (?:2|two) clause bsd(?: license)?
bsd-2-clause: (?:simplified|freebsd) bsd? ?license
bsd-1-clause: (?:bsd 1 clause|1 clause bsd)(?: license)?
bsd-0-clause: (?:bsd zero clause|zero clause bsd|0 clause bsd)(?: license)?
bsd: (?:licensed|released|distributed) under (?:the |a )?bsd(?: style)? license
bsd: (?:the )?bsd(?: style| type| like)? licen[sc]e
bsd: bsd licensed

[0bsd freebsd netbsd openbsd]
bsd-0-clause: 0bsd(?: license)?
bsd-2-clause: (?:the )?(?:freebsd|netbsd|openbsd) (?:license|copyright)

[lesser lgpl library]
lgpl-3.0: (?:gnu )?lesser general public license v?(?:ersion )?3(?: 0)?(?: or (?:at your option )?(?:any )?later(?: version)?)?
lgpl-2.1: (?:gnu )?lesser general public license v?(?:ersion )?2 1(?: or (?:at your option )?(?:any )?later(?: version)?)?
lgpl-2.0: (?:gnu )?library general public license(?: v?(?:ersion )?2(?: 0)?)?
lgpl: (?:gnu )?lesser general public license
lgpl-3.0: lgpl ?v?3(?: 0)?(?: only| or later)?
lgpl-2.1: lgpl ?v?2 1(?: only| or later)?
lgpl-2.0: lgpl ?v?2(?: 0)?(?: only| or later)?
lgpl: lgpl

[affero agpl]
agpl-3.0: (?:gnu )?affero general public license v?(?:ersion )?3(?: 0)?(?: or (?:at your option )?(?:any )?later(?: version)?)?
agpl-1.0: affero general public license v?(?:ersion )?1(?: 0)?
agpl: (?:gnu )?affero general public license
agpl-3.0: agpl ?v?3(?: 0)?(?: only| or later)?
agpl: agpl

[gnu gpl gplv2 gplv3 fsf]
gpl-notice: (?:you can|you may) redistribute it and or modify it under the terms of the gnu (?:lesser |affero |library )?general public license
gpl-notice: either version [123](?: [01])? of the license or at your option any later version
gpl-notice: you should have received a copy of the gnu (?:lesser |affero |library )?general public license
gpl-3.0: gnu general public license v?(?:ersion )?3(?: 0)?(?: or (?:at your option )?(?:any )?later(?: version)?)?
gpl-2.0: gnu general public license v?(?:ersion )?2(?: 0)?(?: or (?:at your option )?(?:any )?later(?: version)?)?
gpl-1.0: gnu general public license v?(?:ersion )?1(?: 0)?
gpl-3.0: gnu gpl ?v?3(?: 0)?
gpl-2.0: gnu gpl ?v?2(?: 0)?
gpl-3.0: gpl ?v?3(?: 0)?(?: only| or later)?
gpl-2.0: gpl ?v?2(?: 0)?(?: only| or later)?
gpl-classpath-exception: gpl(?:v2| 2 0| 2)? with (?:the )?classpath exception
gpl-linking-exception: gpl with (?:a |the )?(?:gcc runtime library|linking|font|bison|autoconf) exception
gfdl: gnu free documentation licen[sc]e(?: v?(?:ersion )?1 [0-3])?
gpl-name: gnu general public licen[sc]e
gpl-name: gnu gpl
gpl-name: (?:under|with) the gpl
gpl-name: gpl compatible
fsf-address: free software foundation inc (?:51 franklin st(?:reet)?|59 temple place|675 mass ave)
fsf: free software foundation

[creative]
cc-by-nc-sa: creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: public)?(?: license)?
cc-by-nc-nd: creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: public)?(?: license)?
cc-by-nc: creative commons attribution non ?commercial(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: public)?(?: license)?
cc-by-nd: creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: public)?(?: license)?
cc-by-sa: creative commons attribution share ?alike(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: public)?(?: license)?
cc-by-name: creative commons attribution(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: public)?(?: license)?
cc0: creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc-pdm: creative commons public domain mark(?: 1 0)?
cc-url: creativecommons org licenses by(?: nc| nd| sa){0,3} [1-4] [05]
creative-commons: (?:a |the )?creative commons licen[sc]e
creative-commons: creative commons

[creativecommons]
cc-url: (?:http |https )?(?:www )?creativecommons org licenses by(?: nc| nd| sa){0,3} [1-4] [05]
cc0: (?:http |https )?(?:www )?creativecommons org publicdomain zero 1 0

[cc cc0]
cc-by-nc-sa: cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd: cc by nc nd(?: [1-4] [05])?
cc-by-nc: cc by nc(?: [1-4] [05])?
cc-by-nd: cc by nd(?: [1-4] [05])?
cc-by-sa: cc by sa(?: [1-4] [05])?
cc-by-version: cc by [1-4] [05](?: international| unported)?
cc-variant: cc by(?: (?:sa|nc|nd))++
cc0: cc0(?: 1 0)?(?: universal)?
cc0: cc zero(?: 1 0)?

[mozilla mpl]
mpl-2.0: this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0: mozilla public license v?(?:ersion )?2(?: 0)?(?: no copyleft exception)?
mpl-1.1: mozilla public license v?(?:ersion )?1 1
mpl-1.0: mozilla public license v?(?:ersion )?1 0
mpl: mozilla public licen[sc]e
mpl-2.0: mpl ?v?2(?: 0)?
mpl-1.1: mpl ?v?1 1
mpl: mpl licensed?

[eclipse epl edl]
epl-2.0: eclipse public license v?(?:ersion )?2(?: 0)?
epl-1.0: eclipse public license v?(?:ersion )?1(?: 0)?
epl: eclipse public licen[sc]e
edl: eclipse distribution license(?: v?(?:ersion )?1 0)?
epl-2.0: epl ?v?2 0
epl-1.0: epl ?v?1 0

[common cddl cpl cecill eupl european]
cddl-1.1: common development and distribution license v?(?:ersion )?1 1
cddl-1.0: common development and distribution license(?: v?(?:ersion )?1 0)?
cddl: cddl(?: 1 [01])?
cpl: common public license(?: v?(?:ersion )?1 0)?
cpal: common public attribution license(?: v?(?:ersion )?1 0)?
cecill: cecill(?: [bc])?(?: (?:free software )?license)?(?: v?(?:ersion )?[12](?: [01])?)?
eupl: european union public licen[sc]e(?: v?(?:ersion )?1 [012])?
eupl: eupl ?v?1 [012]

[public domain unlicense unlicensed]
unlicense: this is free and unencumbered software released into the public domain
unlicense: anyone is free to copy modify publish use compile sell or distribute this software
public-domain: (?:released|dedicated|placed|put) (?:in)?to the public domain
public-domain: (?:is |are )?in the public domain
public-domain: public domain dedication(?: and license)?
public-domain: no rights reserved
public-domain: public domain
unlicense: (?:the )?unlicense
unlicensed: unlicensed

[isc]
isc: (?:the )?isc licen[sc]e
isc: internet systems consortium license
isc: isc licensed

[zlib libpng]
zlib-libpng: zlib libpng license(?: with acknowledgement)?
zlib: (?:the )?zlib licen[sc]e
libpng: libpng license(?: v?(?:ersion )?2)?
zlib-text: altered source versions must be plainly marked as such(?: and must not be misrepresented as being the original software)?

[boost bsl business]
boost-1.0: boost software license v?(?:ersion )?1 0(?: august 17th 2003)?
boost: boost software licen[sc]e
boost-1.0: bsl 1 0
business-source: business source license(?: v?(?:ersion )?1 1)?
business-source: bsl 1 1

[artistic perl]
artistic-2.0: artistic license v?(?:ersion )?2(?: 0)?
artistic-1.0: artistic license v?(?:ersion )?1(?: 0)?(?: perl)?
artistic: (?:the )?(?:perl |clarified )?artistic licen[sc]e
perl: (?:under )?the same terms as perl(?: itself)?

[python psf cnri]
psf-2.0: python software foundation license(?: v?(?:ersion )?2)?
psf-2.0: psf license agreement(?: for python [23](?: [0-9]{1,2})?)?
python: python license(?: 2 0)?
psf: psf licen[sc]e
cnri: cnri (?:open source )?(?:license|python license)

[ruby php ntp openssl openldap ncsa postgresql curl vim tex lppl]
ruby: ruby licen[sc]e
ruby: (?:under )?the same terms as ruby(?: itself)?
php: php license(?: v?(?:ersion )?3 0(?: ?1)?)?
ntp: ntp license
openssl: openssl (?:and ssleay )?license
openldap: openldap public license(?: v?(?:ersion )?2 [0-9])?
ncsa: (?:university of illinois )?ncsa open source license
postgresql: postgresql licen[sc]e
curl: curl license
vim: vim license
lppl: latex project public license(?: v?(?:ersion )?1 [0-3][a-c]?)?
lppl: lppl(?: 1 [0-3][a-c]?)?

[wtfpl beerware microsoft ofl sil font academic afl osl educational upl odbl opendata]
wtfpl: do what the f[a-z]{0,3} you want to public license
wtfpl: wtfpl(?: v?2)?
beerware: beerware license(?: revision 42)?
ms-pl: microsoft public licen[sc]e(?: ms pl)?
ms-rl: microsoft reciprocal licen[sc]e(?: ms rl)?
ofl-1.1: sil open font license v?(?:ersion )?1 1
ofl: (?:sil )?open font licen[sc]e
ofl: ofl 1 [01]
afl: academic free license(?: v?(?:ersion )?[123] [01])?
osl: open software license(?: v?(?:ersion )?[123] [01])?
ecl: educational community license(?: v?(?:ersion )?2 0)?
upl: universal permissive license(?: v?(?:ersion )?1 0)?
odbl: odbl(?: 1 0)?

[open]
odbl: open (?:data commons open )?database license(?: odbl)?(?: v?(?:ersion )?1 0)?
odc-by: open data commons attribution license(?: v?(?:ersion )?1 0)?
pddl: open data commons public domain dedication and license
ogl: open government licen[sc]e(?: v?(?:ersion )?[123](?: 0)?)?
opl: open publication license(?: v?(?:ersion )?1 0)?
open-source: open source licen[sc]e
open-source: osi approved(?: license)?

[server elastic sspl commons polyform rail openrail llama]
sspl: server side public license(?: v?(?:ersion )?1)?
sspl: sspl(?: 1 0)?
elastic: elastic license(?: v?(?:ersion )?2(?: 0)?)?
commons-clause: commons clause(?: license condition)?(?: v?(?:ersion )?1 0)?
polyform: polyform (?:noncommercial|small business|strict|shield|free trial) license(?: 1 0 0)?
openrail: (?:creativeml |bigscience )?open rail m?(?: license)?
openrail: (?:bigscience |bigcode )?openrail(?: m)?(?: license)?
llama: llama [23](?: [0-9])? community license(?: agreement)?

[warranty warranties merchantability liable]
warranty: the software is provided as is without warranty of any kind express or implied
warranty: this software is provided by the (?:copyright holders|author|regents) (?:and contributors )?as is
warranty: without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
warranty: (?:as is )?without (?:any )?warranty of any kind
warranty: (?:without|no) (?:express or implied )?warrant(?:y|ies)
warranty: merchantability (?:or|and) fitness for a particular purpose
warranty: in no event shall the (?:authors?|copyright (?:holders?|owners?)|regents)(?: or contributors| or copyright holders)? be liable
warranty: as is (?:basis )?without warranties or conditions of any kind

[copyright copyrighted copyrights]
copyright: copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2}){0,9}
copyright: copyright c
copyright: copyright (?:holders?|owners?|notice|law)
copyright: copyrighted (?:material|work|by)
copyright: protected by (?:international )?copyright(?: laws?)?
copyright: the above copyright notice and this permission notice shall be included in all copies

[proprietary confidential commercial]
proprietary: proprietary and confidential(?: information)?
proprietary: confidential and proprietary(?: information)?
proprietary: unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: of this (?:file|document|work))?(?: via any medium)? is strictly prohibited
proprietary: proprietary licen[sc]e
commercial: commercial licen[sc]e(?: agreement)?
commercial: (?:for )?non ?commercial (?:use|purposes) only
commercial: not for commercial use

[unauthorized unauthorised]
proprietary: unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: of this (?:file|document|work))?(?: via any medium)? is (?:strictly )?prohibited

[terms eula agreement]
terms: (?:subject to|governed by|under) the terms of (?:use|service)
terms: terms of (?:use|service)
terms: terms and conditions
eula: end user licen[sc]e agreement
eula: eula
license-agreement: software licen[sc]e agreement

[licensed license licence]
license-reference: licensed under (?:the terms of )?(?:the |a )?[a-z0-9]+ (?:public )?licen[sc]e
license-reference: released under (?:the terms of )?(?:the |a )?[a-z0-9]+ (?:public )?licen[sc]e
license-reference: distributed under (?:the terms of )?(?:the |a )?[a-z0-9]+ (?:public )?licen[sc]e
license-reference: see (?:the )?(?:accompanying )?(?:file )?licen[sc]e(?: (?:txt|md|file))?(?: file)? for (?:details|more information|the full text|terms)
license-reference: see licen[sc]e (?:txt|md|file)
license-reference: licen[sc]e (?:txt|md)
license-reference: dual licensed(?: under)?
"""


def rules() -> list[tuple[tuple[str, ...], str, str]]:
    """(gate, label, pattern), in order of priority."""
    out, gate = [], ()
    for line in RULES.split("\n"):
        if line.startswith("["):
            gate = tuple(line.strip("[]").split(" "))
        elif line:
            label, _, pattern = line.partition(": ")
            out.append((gate, label, pattern))
    return out
