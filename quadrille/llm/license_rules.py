"""Signature rules of license scans, written by hand.

A line has label, priority, confidence and a pattern over the lower-case words of a text with one space between them.
Rules of whole sentences come before rules of names, names with a version before names without. ``V`` stands for
an optional word before a version (all words are lower-case). Order counts among detections of the same place, length and priority.
"""

from __future__ import annotations

_TEXT = r"""
mit 95 1.0 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit 90 1.0 to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
mit 85 0.95 the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit 85 0.9 in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise
mit 80 0.9 (?:released|licensed|distributed|available|published|provided) under the (?:terms of the )?(?:expat |mit )license
mit 60 0.8 (?:the )?mit(?: expat)? license
mit 85 0.95 spdx license identifier mit
mit-0 80 0.9 mit no attribution(?: license)?
x11 85 0.95 except as contained in this notice the names? of (?:[^ ]+ ){1,12}?shall not be used in advertising or otherwise to promote the sale use or other dealings
x11 70 0.9 (?:the )?x11 license
ncsa 90 1.0 to deal with the software without restriction including without limitation the rights to use copy modify merge publish
ncsa 70 0.9 university of illinois ncsa open source license
isc 95 1.0 permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc 90 1.0 permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
isc 80 0.9 the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
isc 60 0.8 (?:the )?isc license
hpnd 85 0.95 permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted provided
postgresql 90 1.0 for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice
postgresql 70 0.9 (?:the )?postgresql licen[cs]e
bsd 70 0.9 redistribution and use in source and binary forms with or without modification are permitted
bsd 72 0.9 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd 72 0.9 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd 70 0.9 this software is provided by the (?:copyright holders and contributors|regents and contributors|authors?) as is and any express or implied warranties
bsd 65 0.85 however caused and on any theory of liability whether in contract strict liability or tort
bsd-3-clause 85 0.95 neither the name of (?:[^ ]+ ){1,20}?nor the names of (?:its|their|the) contributors may be used to endorse or promote products
bsd-3-clause 85 0.95 the names? of the (?:author|authors|contributors) may not be used to endorse or promote products derived from this software
bsd-4-clause 85 0.95 all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause 80 0.9 (?:the )?(?:2 clause|two clause|simplified|freebsd) bsd license
bsd-2-clause 80 0.9 bsd 2 clause(?: license)?
bsd-3-clause 80 0.9 (?:the )?(?:3 clause|three clause|new|modified|revised) bsd license
bsd-3-clause 80 0.9 bsd 3 clause(?: license)?
bsd-4-clause 80 0.9 bsd 4 clause(?: license)?
bsd-4-clause 80 0.9 (?:4 clause|four clause|original) bsd license
0bsd 80 0.9 (?:0bsd|zero clause bsd|bsd zero clause)(?: license)?
bsd 40 0.6 (?:the )?bsd(?: style| like)? licen[cs]e
apache-2.0 95 1.0 licensed under the apache license V2(?: 0)?
apache-2.0 90 1.0 you may not use this file except in compliance with the license
apache-2.0 85 0.9 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 85 0.9 each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except as stated in this section patent) license
apache-2.0 75 0.85 see the license for the specific language governing permissions and limitations under the license
apache-2.0 70 0.85 terms and conditions for use reproduction and distribution
apache-2.0 80 0.9 apache (?:software )?license V2(?: 0)?
apache-2.0 85 0.95 spdx license identifier apache 2 0
apache-2.0 70 0.9 (?:http|https) (?:www )?apache org licenses license 2 0(?: txt| html)?
apache-1.1 80 0.9 apache (?:software )?license V1 1
apache-1.1 85 0.95 this product includes software developed by the apache (?:software foundation|group)
apache 40 0.6 (?:the )?apache (?:software )?license
gpl 90 0.95 this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl 85 0.9 you should have received a copy of the gnu general public license along with this (?:program|software|file)
gpl 80 0.85 the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change
gpl 80 0.85 when we speak of free software we are referring to freedom not price
gpl-3.0 85 0.9 the gnu general public license is a free copyleft license for software and other kinds of works
gpl-2.0 85 0.9 you must cause the modified files to carry prominent notices stating that you changed the files and the date of any change
gpl-3.0 85 0.9 to propagate a work means to do anything with it that without permission would make you directly or secondarily liable
gpl-3.0 85 0.9 no covered work shall be deemed part of an effective technological measure
gpl 60 0.75 this program is distributed in the hope that it will be useful but without any warranty
gpl 60 0.7 everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl-2.0-or-later 98 1.0 (?:gnu )?general public license (?:as published by the free software foundation )?(?:either )?V2(?: 0)?(?: of the license)? or (?:at your option )?any later version
gpl-3.0-or-later 98 1.0 (?:gnu )?general public license (?:as published by the free software foundation )?(?:either )?V3(?: 0)?(?: of the license)? or (?:at your option )?any later version
gpl-2.0-only 96 1.0 (?:gnu )?general public license (?:as published by the free software foundation )?V2(?: 0)?(?: of the license)? only
gpl-3.0-only 96 1.0 (?:gnu )?general public license (?:as published by the free software foundation )?V3(?: 0)?(?: of the license)? only
gpl-1.0 85 0.95 (?:gnu )?general public license V1(?: 0)?
gpl-2.0 85 0.95 (?:gnu )?general public license V2(?: 0)?
gpl-3.0 85 0.95 (?:gnu )?general public license V3(?: 0)?
gpl 50 0.7 (?:the )?(?:gnu )?general public license
gpl-2.0 85 0.95 spdx license identifier gpl 2 0(?: or later| only)?
gpl-3.0 85 0.95 spdx license identifier gpl 3 0(?: or later| only)?
gpl-2.0 70 0.85 (?:gnu )?gpl(?: license)? ?(?:version |v )?2(?: 0)?
gpl-3.0 70 0.85 (?:gnu )?gpl(?: license)? ?(?:version |v )?3(?: 0)?
gpl-2.0 70 0.85 (?:gnu )?gplv2
gpl-3.0 70 0.85 (?:gnu )?gplv3
gpl 30 0.5 (?:the )?gnu gpl
gpl-exception 75 0.85 as a special exception (?:[^ ]+ ){1,12}?(?:gives? you|give|grants?) (?:unlimited )?permission to (?:link|copy)
classpath-exception 80 0.9 linking this library statically or dynamically with other modules is making a combined work based on this library
lgpl 90 0.95 this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl 85 0.9 you should have received a copy of the gnu (?:lesser|library) general public license along with
lgpl 80 0.85 this license the (?:lesser|library) general public license applies to some specially designated software
lgpl-2.1 85 0.95 (?:gnu )?lesser general public license V2 1
lgpl-3.0 85 0.95 (?:gnu )?lesser general public license V3(?: 0)?
lgpl-2.0 85 0.95 (?:gnu )?library general public license V2(?: 0)?
lgpl 60 0.8 (?:the )?(?:gnu )?lesser general public license
lgpl 60 0.8 (?:the )?(?:gnu )?library general public license
lgpl 30 0.5 (?:the )?(?:gnu )?lgpl(?: license)?(?: (?:version |v )?(?:2 1|3(?: 0)?))?
agpl 90 0.95 under the terms of the gnu affero general public license
agpl 80 0.9 all users interacting with it remotely through a computer network
agpl-3.0 85 0.95 (?:gnu )?affero general public license V3(?: 0)?
agpl 60 0.8 (?:the )?(?:gnu )?affero general public license
agpl-3.0 70 0.85 (?:gnu )?agpl ?(?:version |v )?3(?: 0)?
gfdl 90 1.0 permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl 75 0.85 with no invariant sections no front cover texts and no back cover texts
gfdl 60 0.8 (?:the )?(?:gnu )?free documentation license(?: V1 [0-3])?
mpl-2.0 95 1.0 this source code form is subject to the terms of the mozilla public license
mpl-2.0 85 0.95 if a copy of the mpl was not distributed with this file you can obtain one at
mpl-2.0 80 0.9 this source code form is incompatible with secondary licenses
mpl-1.1 90 0.95 the contents of this file are subject to the mozilla public license
mpl-1.1 85 0.95 mozilla public license V1 1
mpl-2.0 85 0.95 mozilla public license V2(?: 0)?
mpl 50 0.7 (?:the )?mozilla public license
epl 90 0.95 this program and the accompanying materials are made available under the terms of the eclipse public license
epl 80 0.9 any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement
epl-1.0 85 0.95 eclipse public license V1(?: 0)?
epl-2.0 85 0.95 eclipse public license V2(?: 0)?
epl 50 0.7 (?:the )?eclipse public license
edl-1.0 70 0.85 eclipse distribution license(?: V1(?: 0)?)?
cpl-1.0 75 0.9 common public license(?: V1(?: 0)?)?
ipl-1.0 75 0.9 ibm public license(?: V1(?: 0)?)?
cddl-1.0 90 0.95 the contents of this file are subject to the terms of the common development and distribution license
cddl-1.0 80 0.9 common development and distribution license(?: V1(?: 0)?)?
cddl-1.0 70 0.9 cddl(?: V1(?: 0)?)?
eupl 85 0.95 licensed under the eupl
eupl 70 0.9 european union public licen[cs]e(?: V1 [012])?
cecill 80 0.9 ce logiciel est régi par la licence cecill
cecill 75 0.9 this software is governed by the cecill(?: b| c)? license under french law
unlicense 90 1.0 this is free and unencumbered software released into the public domain
unlicense 88 1.0 anyone is free to copy modify publish use compile sell or distribute this software
unlicense 85 0.95 dedicate any and all copyright interest in the software to the public domain
unlicense 60 0.8 (?:the )?unlicense
wtfpl 90 1.0 do what the fuck you want to public license
wtfpl 85 0.95 you just do what the fuck you want to
wtfpl 70 0.9 (?:the )?wtfpl
beerware 85 0.95 as long as you retain this notice you can do whatever you want with this stuff
beerware 80 0.9 you can buy me a beer in return
json 85 0.95 the software shall be used for good not evil
vim 80 0.9 vim is charityware
zlib 90 1.0 altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib 88 1.0 the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib 80 0.9 permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
zlib 75 0.85 this notice may not be removed or altered from any source distribution
zlib 60 0.8 (?:the )?zlib(?: libpng)? license
libpng 75 0.9 (?:the )?libpng license
boost-1.0 90 1.0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
boost-1.0 85 0.95 unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor
boost-1.0 80 0.9 boost software license(?: V1(?: 0)?)?
artistic 85 0.95 the intent of this document is to state the conditions under which a package may be copied
artistic 75 0.85 under the same terms as perl(?: itself)?
artistic-1.0 80 0.9 artistic license V1(?: 0)?
artistic-2.0 80 0.9 artistic license V2(?: 0)?
artistic 50 0.7 (?:the )?artistic license
python-2.0 90 0.95 this license agreement is between the python software foundation
python-2.0 85 0.95 psf is making python available to licensee on an as is basis
python-2.0 80 0.9 python software foundation license(?: V2)?
ruby 85 0.95 you may make and give away verbatim copies of the source form of the software without restriction
ruby 60 0.8 (?:the )?ruby license
php 85 0.95 this product includes php(?: software)? freely available from
php-3.01 75 0.9 (?:the )?php license(?: V3 0(?:1)?)?
openssl 90 0.95 this product includes software developed by the openssl project
openssl 85 0.95 this product includes cryptographic software written by eric young
openssl 60 0.8 openssl license
sleepycat 85 0.95 redistributions in any form must be accompanied by information on how to obtain complete source code
ms-pl 75 0.9 microsoft public license
ms-rl 75 0.9 microsoft reciprocal license
apsl-2.0 75 0.9 apple public source license(?: V2(?: 0)?)?
osl-3.0 75 0.9 open software license(?: V[123](?: [01])?)?
afl-3.0 75 0.9 academic free license(?: V[123](?: [01])?)?
upl-1.0 75 0.9 universal permissive license(?: V1(?: 0)?)?
w3c 80 0.9 w3c software (?:and document )?(?:notice and )?license
lppl-1.3c 85 0.95 this work may be distributed and or modified under the conditions of the latex project public license
lppl 60 0.8 latex project public license
ofl-1.1 90 1.0 this font software is licensed under the sil open font license
ofl-1.1 85 0.95 the ofl allows the licensed fonts to be used studied modified and redistributed freely
ofl-1.1 80 0.9 (?:sil )?open font license(?: V1 [01])?
ubuntu-font 75 0.9 ubuntu font licen[cs]e
mulanpsl-2.0 75 0.9 mulan psl ?v?2
odbl-1.0 90 1.0 (?:is )?made available under the open database license
odbl-1.0 80 0.9 open database license(?: odbl)?(?: V1(?: 0)?)?
dbcl-1.0 80 0.9 any rights in individual contents of the database are licensed under the database contents license
odc-by 80 0.9 open data commons attribution license(?: V1(?: 0)?)?
pddl-1.0 80 0.9 (?:odc )?public domain dedication and licen[cs]e
cdla 75 0.9 community data license agreement (?:permissive|sharing)
ogl 85 0.95 contains public sector information licensed under the open government licen[cs]e
ogl 70 0.85 open government licen[cs]e(?: V[123](?: 0)?)?
cc0-1.0 90 1.0 the person who associated a work with this deed has dedicated the work to the public domain
cc0-1.0 85 0.95 has waived all copyright and related or neighboring rights
cc0-1.0 85 0.95 cc0(?: 1 0)?(?: universal)?
cc0-1.0 85 0.95 creative commons zero(?: V1 0)?(?: universal)?
cc 60 0.8 this (?:work|article|content|page|site|material) is licensed under (?:a|the) creative commons
cc 55 0.75 (?:http|https) (?:www )?creativecommons org licenses [a-z]+(?: [a-z]+)*(?: [1-4] [05])?
cc 50 0.7 you are free to share copy and redistribute the material in any medium or format
cc 50 0.7 you must give appropriate credit provide a link to the license and indicate if changes were made
cc-sa 60 0.8 if you remix transform or build upon the material you must distribute your contributions under the same license as the original
cc-nd 60 0.8 if you remix transform or build upon the material you may not distribute the modified material
cc-nc 60 0.8 you may not use the material for commercial purposes
cc 20 0.5 (?:a )?creative commons(?: license)?
public-domain 75 0.85 this (?:work|file|image|document|software|code) (?:is|has been (?:placed|released)) in(?:to)? the public domain
public-domain 70 0.85 no rights are reserved (?:and )?(?:you are )?free to use
public-domain 60 0.8 (?:released|placed|dedicated|is) (?:into|in|to) the public domain
public-domain 60 0.75 (?:a )?work of the united states government
public-domain 30 0.5 (?:the )?public domain
sspl-1.0 90 0.95 make the service source code available via network download to everyone at no charge
sspl-1.0 80 0.9 server side public license(?: V1)?
busl-1.1 90 0.95 hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
busl-1.1 80 0.9 business source license(?: V1 1)?
elastic-2.0 90 0.95 you may not provide the software to third parties as a hosted or managed service
elastic-2.0 80 0.9 elastic license(?: V2(?: 0)?)?
commons-clause 85 0.95 the license does not grant to you the right to sell the software
commons-clause 75 0.9 commons clause(?: license condition)?
polyform 75 0.9 polyform (?:noncommercial|strict|shield|perimeter|small business|internal use|free trial) license
prosperity 75 0.9 prosperity public license
parity 75 0.9 parity public license
openrail 80 0.9 (?:creativeml |bigscience )?open ?rail(?: [ms]+)?(?: m)? license
openrail 70 0.8 use based restrictions (?:as )?(?:referenced|set forth) in (?:paragraph 5|attachment a)
llama-community 85 0.95 llama [0-9](?: [0-9])? community license agreement
llama-community 70 0.8 built with (?:meta )?llama
gemma 75 0.9 gemma (?:is provided under and subject to the gemma )?terms of use
hippocratic 75 0.9 hippocratic license(?: V[123](?: [01])?)?
dual-license 60 0.75 (?:dual|double|triple) licensed under
dual-license 55 0.7 licensed under either of
proprietary 80 0.9 unauthorized (?:copying|reproduction|distribution|use|duplication)(?: [^ ]+){0,8}? is (?:strictly )?prohibited
proprietary 80 0.9 no part of this (?:publication|book|document|work) may be reproduced(?: distributed| stored)?
proprietary 80 0.9 reproduction in whole or in part without (?:written |express )?permission is (?:strictly )?(?:prohibited|forbidden)
proprietary 75 0.85 this material may not be published broadcast rewritten or redistributed
proprietary 75 0.85 (?:contains|is) (?:the )?(?:confidential|proprietary) (?:and (?:confidential|proprietary) )?(?:information|property) (?:of|and)
proprietary 70 0.85 (?:proprietary and confidential|confidential and proprietary)
proprietary 70 0.85 (?:may not|must not|cannot) be (?:copied|reproduced|redistributed|republished)(?: or (?:copied|reproduced|redistributed|republished))*
proprietary 70 0.85 without (?:the )?(?:express |prior )*(?:prior |express )?written (?:permission|consent)
proprietary 60 0.8 (?:may not|do not) (?:copy|reproduce|redistribute)(?: or (?:copy|reproduce|redistribute))*
proprietary 60 0.8 (?:the software|this software|the product) is licensed not sold
proprietary 60 0.75 redistribution is (?:strictly )?(?:prohibited|forbidden|not permitted|not allowed)
proprietary 55 0.7 (?:for )?internal use only
proprietary 50 0.7 trade secrets? of
non-commercial 60 0.75 (?:for )?(?:personal|private|educational)(?: and| or)? non ?commercial use only
non-commercial 50 0.65 not for (?:re)?sale
non-commercial 50 0.65 (?:for )?evaluation (?:purposes|use) only
reserved 50 0.7 (?:all|some|no|any) (?:other )?rights (?:are )?reserved
reserved 50 0.7 alle rechte vorbehalten
reserved 50 0.7 tous droits réservés
reserved 50 0.7 todos los derechos reservados
reserved 50 0.7 todos os direitos reservados
reserved 50 0.7 tutti i diritti riservati
reserved 50 0.7 alle rechten voorbehouden
proprietary 65 0.8 nachdruck(?: auch auszugsweise)? (?:nur mit (?:schriftlicher )?genehmigung|verboten|untersagt)
proprietary 65 0.8 (?:toute )?reproduction (?:même partielle )?(?:est )?interdite
proprietary 65 0.8 prohibida (?:la|su) reproducción(?: total o parcial)?
cc 55 0.75 namensnennung(?: nicht ?kommerziell)?(?: weitergabe unter gleichen bedingungen| keine bearbeitungen?)
cc 55 0.75 (?:attribution|paternité) pas d utilisation commerciale(?: partage dans les mêmes conditions| pas de modification)?
cc 55 0.75 (?:reconocimiento|atribución)(?: no ?comercial)? (?:compartir ?igual|sin ?obra ?derivada)
gpl 50 0.7 licence publique générale(?: gnu)?
gpl 50 0.7 licencia pública general(?: de)?(?: gnu)?
copyright 40 0.6 copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*
copyright 30 0.5 crown copyright
copyright 20 0.4 copyright(?: c)? (?:by )?(?:the )?(?:[^ ]+ )?(?:authors?|contributors?|holders?|owners?|inc|ltd|gmbh)
trademark 30 0.4 (?:is an?|are) (?:registered )?trademarks? of
trademark 30 0.4 (?:are|is) (?:the )?(?:property|trademarks?) of (?:their|its) respective (?:owners?|holders?)
patent 40 0.5 patents? pending
patent-grant 50 0.7 (?:perpetual )?worldwide non exclusive no charge royalty free(?: irrevocable)? patent license
eula 70 0.85 by (?:installing|using|downloading|accessing|opening)(?: or (?:installing|using|downloading|accessing))* (?:this|the) (?:software|product|package|file|site) you agree
eula 60 0.8 end user licen[cs]e agreement
tos 40 0.6 terms of (?:use|service)(?: apply)?
government-rights 60 0.75 (?:limited|restricted) rights (?:legend|notice)
government-rights 55 0.7 rights in technical data and computer software
warranty-disclaimer 70 0.8 there is no warranty for the program to the extent permitted by applicable law
warranty-disclaimer 65 0.8 the entire risk as to the quality and performance of the (?:program|software|covered software) is with you
warranty-disclaimer 60 0.8 (?:provided )?as is without (?:any )?warrant(?:y|ies)(?: of any kind)?(?: either)?(?: express or implied)?
warranty-disclaimer 60 0.8 (?:implied )?warranties of merchantability(?: and)? fitness for a particular purpose
warranty-disclaimer 40 0.5 use (?:it )?(?:entirely )?at your own risk
no-ai-training 80 0.9 (?:may not|must not|do not) (?:be )?use(?:d)? (?:[^ ]+ ){0,4}?(?:for|to)(?: ai| machine learning| model)? training
no-ai-training 75 0.9 (?:text and data mining|tdm)(?: rights)?(?: is| are)? (?:prohibited|reserved|not permitted)
no-ai-training 75 0.9 no (?:part of this (?:book|work|site) may be used )?(?:for )?(?:generative )?ai training
verbatim 60 0.75 verbatim copying and distribution of this entire (?:article|document|page) (?:is|are) permitted
attribution 45 0.6 (?:free to use|may be used|can be used) (?:freely )?(?:with|provided|as long as) (?:proper |appropriate )?(?:attribution|credit)
"""

#: Attribution families by version: the words of each kind; six kinds by five versions, in two spellings.
CC_KINDS = {
    "by": "attribution", "by-sa": "attribution share ?alike", "by-nc": "attribution non ?commercial", "by-nd": "attribution no ?deriv(?:ative)?s?",
    "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?",
}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
_VERSION = "(?:version |v )?"


def hand_written() -> list[tuple[str, int, float, str]]:
    rows = [line.split(" ", 3) for line in _TEXT.strip().split("\n")]
    return [(label, int(priority), float(score), pattern.replace("V", _VERSION)) for label, priority, score, pattern in rows]


def by_version() -> list[tuple[str, int, float, str]]:
    rules = []
    for kind, words in CC_KINDS.items():
        short = kind.replace("-", " ")
        for version in CC_VERSIONS:
            label = f"cc-{kind}-{version.replace(' ', '.')}"
            rules.append((label, 92, 1.0, f"cc {short} {_VERSION}{version}"))
            rules.append((label, 92, 1.0, f"creative commons {words} {_VERSION}{version}(?: (?:international|unported|generic))?"))
        rules.append((f"cc-{kind}", 60 + len(kind), 0.8, f"cc {short}"))
        rules.append((f"cc-{kind}", 60 + len(kind), 0.8, f"creative commons {words}"))
    return rules


#: (label, priority, confidence, pattern), in order.
RULES = hand_written() + by_version()
