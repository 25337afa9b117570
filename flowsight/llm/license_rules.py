"""Signature rules of licenses, in order of priority.

Each line is ``label | keyword | pattern``. Patterns are matched against a text's words in lower case
with single spaces between them ("version 2.0" reads ``version 2 0``), from word border to word
border. A rule is tried only on texts that hold its keyword, which every match contains.
"""

from __future__ import annotations

from typing import NamedTuple

#: Sentences that only the text of a license or its notice has.
TEXTS = r"""
mit | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | the above copyright notice and this permission notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | without restriction including without limitation | permission is hereby granted free of charge to any person obtaining a copy (?:\S+ ){0,20}without restriction including without limitation (?:\S+ ){0,25}permit persons to whom the software is furnished to do so the software is provided
x11 | name of the x consortium | except as contained in this notice the name of the x consortium shall not be used
icu | data files or software | permission is hereby granted (?:\S+ ){0,12}copy of the unicode data files or software
ntp | for any purpose with or without fee | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted
isc | copy modify and or distribute this software | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
0bsd | copy modify and or distribute this software | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
hpnd | in supporting documentation | that both that copyright notice and this permission notice appear in supporting documentation
bsd-2-clause | redistributions in binary form | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause | endorse or promote products | neither the names? of (?:\S+ ){1,12}may be used to endorse or promote products
bsd-4-clause | all advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause-clear | no express or implied licenses to any party | no express or implied licenses to any party s patent rights are granted by this license
bsd-1-clause | the following condition is met | redistribution and use in source and binary forms (?:\S+ ){0,10}provided that the following condition is met
apache-2.0 | licensed under the apache license | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | for inclusion in the work by the licensor | contribution shall mean any work of authorship (?:\S+ ){0,30}for inclusion in the work by the licensor
apache-1.1 | apache software foundation | this product includes software developed by the apache software foundation
apache-1.0 | the apache group | this product includes software developed by the apache group
gpl-3.0-or-later | either version 3 | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0-or-later | either version 2 | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0 | version 3 29 june 2007 | gnu general public license version 3 29 june 2007
gpl-2.0 | version 2 june 1991 | gnu general public license version 2 june 1991
gpl-2.0 | the program or a work based on it | you may copy and distribute the program or a work based on it
gpl-2.0 | the program or any work based on the program | you must cause any work that you distribute (?:\S+ ){0,14}the program or any work based on the program
gpl-1.0-or-later | either version 1 | gnu general public license as published by the free software foundation either version 1 or at your option any later version
lgpl-3.0-or-later | either version 3 | gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2.1-or-later | either version 2 1 | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-2.0-or-later | either version 2 | gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
lgpl-2.1 | version 2 1 february 1999 | gnu lesser general public license version 2 1 february 1999
lgpl-3.0 | version 3 29 june 2007 | gnu lesser general public license version 3 29 june 2007
agpl-3.0-or-later | either version 3 | gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl-3.0 | version 3 19 november 2007 | gnu affero general public license version 3 19 november 2007
agpl-3.0 | remote network interaction | remote network interaction use with the gnu general public license
gfdl | no invariant sections | with no invariant sections (?:with )?no front cover texts and (?:with )?no back cover texts
gfdl-1.3-or-later | free documentation license | gnu free documentation license version 1 3 or any later version
gpl-3.0 | there is no warranty for the program | there is no warranty for the program to the extent permitted by applicable law
gpl-linking-exception | special exception | as a special exception (?:\S+ ){0,20}permission to link
classpath-exception-2.0 | linking this library | linking this library statically or dynamically with other modules is making a combined work
gcc-exception-3.1 | gcc runtime library exception | gcc runtime library exception version 3 1
mpl-2.0 | subject to the terms of the mozilla public license | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | subject to the mozilla public license | the contents of this file are subject to the mozilla public license version 1 1
cddl-1.0 | common development and distribution license | subject to the terms of the common development and distribution license
epl-2.0 | eclipse public license | terms of the eclipse public license (?:v|version )? ?2 0
epl-1.0 | eclipse public license | terms of the eclipse public license v1 0|terms of the eclipse public license (?:v|version) 1 0
unlicense | free and unencumbered software | this is free and unencumbered software released into the public domain
wtfpl | do what the fuck you want | you just do what the fuck you want to
zlib | altered source versions | altered source versions must be plainly marked as such and must not be misrepresented
zlib | wrote the original software | you must not claim that you wrote the original software
bsl-1.0 | boost software license | distributed under the boost software license version 1 0
artistic-2.0 | the artistic license 2 0 | the artistic license 2 0 copyright
artistic-1.0 | conditions under which a package may be copied | the intent of this document is to state the conditions under which a package may be copied
ofl-1.1 | sil open font license | this font software is licensed under the sil open font license version 1 1
python-2.0 | python software foundation license | python software foundation license version 2
postgresql | copy modify and distribute this software and its documentation | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
openssl | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | eric young | this product includes cryptographic software written by eric young
curl | copy modify and distribute this software for any purpose | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided
beerware | buy me a beer | you can buy me a beer in return
json | shall be used for good not evil | the software shall be used for good not evil
ncsa | university of illinois | university of illinois ncsa open source license
php-3.01 | php license version 3 01 | the php license version 3 01
vim | vim license | vim license (?:\S+ ){0,20}distribute (?:\S+ ){0,5}copies of vim
cc0-1.0 | waived all copyright and related | has waived all copyright and related or neighboring rights
cc-by-4.0 | attribution 4 0 international | creative commons attribution 4 0 international public license
cc-by-sa-4.0 | sharealike 4 0 international | creative commons attribution sharealike 4 0 international public license
elastic-2.0 | elastic license | hosted or managed service (?:\S+ ){0,30}elastic license|elastic license 2 0 acceptance
sspl-1.0 | server side public license | subject to the terms of the server side public license
bsl-1.1 | business source license | business source license 1 1 parameters|the business source license (?:\S+ ){0,6}is not an open source license
commons-clause | commons clause | commons clause license condition
proprietary | confidential | (?:proprietary and confidential|confidential and proprietary) (?:information|material|unauthorized copying)
proprietary | unauthorized copying | unauthorized copying of this (?:file|software|document) via any medium is strictly prohibited
"""

#: Names of licenses in identifier lines.
IDENTIFIERS = r"""
mit | spdx license identifier | spdx license identifier mit(?! 0)
mit-0 | spdx license identifier | spdx license identifier mit 0
apache-2.0 | spdx license identifier | spdx license identifier apache 2 0
gpl-2.0 | spdx license identifier | spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later | spdx license identifier | spdx license identifier gpl 2 0 or later
gpl-3.0 | spdx license identifier | spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later | spdx license identifier | spdx license identifier gpl 3 0 or later
lgpl-2.1 | spdx license identifier | spdx license identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later | spdx license identifier | spdx license identifier lgpl 2 1 or later
lgpl-3.0 | spdx license identifier | spdx license identifier lgpl 3 0(?: only)?
lgpl-3.0-or-later | spdx license identifier | spdx license identifier lgpl 3 0 or later
agpl-3.0 | spdx license identifier | spdx license identifier agpl 3 0(?: only)?
agpl-3.0-or-later | spdx license identifier | spdx license identifier agpl 3 0 or later
bsd-2-clause | spdx license identifier | spdx license identifier bsd 2 clause
bsd-3-clause | spdx license identifier | spdx license identifier bsd 3 clause
0bsd | spdx license identifier | spdx license identifier 0bsd
isc | spdx license identifier | spdx license identifier isc
mpl-2.0 | spdx license identifier | spdx license identifier mpl 2 0
epl-1.0 | spdx license identifier | spdx license identifier epl 1 0
epl-2.0 | spdx license identifier | spdx license identifier epl 2 0
cddl-1.0 | spdx license identifier | spdx license identifier cddl 1 0
bsl-1.0 | spdx license identifier | spdx license identifier bsl 1 0
zlib | spdx license identifier | spdx license identifier zlib
unlicense | spdx license identifier | spdx license identifier unlicense
wtfpl | spdx license identifier | spdx license identifier wtfpl
cc0-1.0 | spdx license identifier | spdx license identifier cc0 1 0
cc-by-4.0 | spdx license identifier | spdx license identifier cc by 4 0
cc-by-sa-4.0 | spdx license identifier | spdx license identifier cc by sa 4 0
ofl-1.1 | spdx license identifier | spdx license identifier ofl 1 1
artistic-2.0 | spdx license identifier | spdx license identifier artistic 2 0
python-2.0 | spdx license identifier | spdx license identifier (?:python|psf) 2 0
postgresql | spdx license identifier | spdx license identifier postgresql
sspl-1.0 | spdx license identifier | spdx license identifier sspl 1 0
elastic-2.0 | spdx license identifier | spdx license identifier elastic 2 0
proprietary | spdx license identifier | spdx license identifier licenseref \S+
"""

#: Sentences that put a work under a license.
NOTICES = r"""
mit | mit licen | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?mit licen[cs]e
mit | mit x11 licen | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?mit x11 licen[cs]e
mit | expat licen | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?expat licen[cs]e
apache-2.0 | apache | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: licen[cs]e)?(?: version)? (?:v ?)?2(?: 0)?
apache | apache | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[cs]e
gpl-3.0 | gnu general public license | licensed under the gnu general public license (?:version|v) ?3(?: 0)?
gpl-2.0 | gnu general public license | licensed under the gnu general public license (?:version|v) ?2(?: 0)?
gpl | general public license | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public license
gpl-3.0 | gpl | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl ?(?:version |v )?v?3(?: 0)?
gpl-2.0 | gpl | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl ?(?:version |v )?v?2(?: 0)?
gpl | gpl | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl
lgpl | lesser general public license | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lesser general public license
lgpl | lgpl | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl
agpl-3.0 | affero general public license | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?affero general public license
agpl-3.0 | agpl | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?agpl
bsd | bsd | (?:licensed|released|distributed|available|published) under (?:the |a )?(?:terms of )?(?:the )?(?:modified |simplified |revised |new )?bsd(?: style)? licen[cs]e
bsd-2-clause | 2 clause bsd | (?:licensed|released|distributed|available|published) under (?:the |a )?2 clause bsd licen[cs]e
bsd-3-clause | 3 clause bsd | (?:licensed|released|distributed|available|published) under (?:the |a )?3 clause bsd licen[cs]e
isc | isc licen | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?isc licen[cs]e
mpl | mozilla public license | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?mozilla public license
epl | eclipse public license | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?eclipse public license
cc-by-4.0 | cc by 4 0 | (?:licensed|released|distributed|available|published) under (?:a |the )?(?:creative commons )?cc by 4 0
cc-by-sa-4.0 | cc by sa 4 0 | (?:licensed|released|distributed|available|published) under (?:a |the )?(?:creative commons )?cc by sa 4 0
cc-by-nc-4.0 | cc by nc 4 0 | (?:licensed|released|distributed|available|published) under (?:a |the )?(?:creative commons )?cc by nc 4 0
cc-by-nd-4.0 | cc by nd 4 0 | (?:licensed|released|distributed|available|published) under (?:a |the )?(?:creative commons )?cc by nd 4 0
cc-by-nc-sa-4.0 | cc by nc sa 4 0 | (?:licensed|released|distributed|available|published) under (?:a |the )?(?:creative commons )?cc by nc sa 4 0
cc-by-nc-nd-4.0 | cc by nc nd 4 0 | (?:licensed|released|distributed|available|published) under (?:a |the )?(?:creative commons )?cc by nc nd 4 0
creative-commons | creative commons | (?:licensed|released|distributed|available|published) under (?:a |the )?(?:terms of )?(?:a |the )?creative commons(?: attribution)?(?: \S+){0,3} licen[cs]e
unlicense | unlicense | (?:licensed|released|distributed|available|published) (?:under|into) (?:the )?unlicense
public-domain | public domain | (?:dedicated|released|placed|put|given) (?:in|into|to) the public domain
zlib | zlib | (?:licensed|released|distributed|available|published) under (?:the )?zlib(?: libpng)? licen[cs]e
bsl-1.0 | boost software license | (?:licensed|released|distributed|available|published) under (?:the )?boost software license
artistic | artistic license | (?:licensed|released|distributed|available|published) under (?:the )?(?:perl )?artistic license
ofl-1.1 | open font license | (?:licensed|released|distributed|available|published) under (?:the )?(?:sil )?open font license
perl | same terms as perl | (?:under|on) the same terms as perl(?: itself)?
eupl | european union public licen | (?:licensed|released|distributed|available|published) under (?:the )?european union public licen[cs]e
odbl | open database license | (?:licensed|made available|released) under (?:the )?open database license
proprietary | all rights reserved | copyright (?:c )?(?:\S+ ){0,8}all rights reserved
"""

#: Names with a version.
VERSIONS = r"""
apache-2.0 | apache | apache(?: software)? licen[cs]e(?: version)? (?:v ?)?2(?: 0)?
apache-2.0 | apache 2 0 | apache 2 0(?: licen[cs]e)?
apache-2.0 | apache2 | apache2(?: licen[cs]e)?
apache-1.1 | apache | apache(?: software)? licen[cs]e(?: version)? 1 1
apache-1.0 | apache | apache(?: software)? licen[cs]e(?: version)? 1 0
gpl-3.0 | general public license | (?:gnu )?general public license (?:version |v )?v?3(?: 0)?
gpl-2.0 | general public license | (?:gnu )?general public license (?:version |v )?v?2(?: 0)?
gpl-1.0 | general public license | (?:gnu )?general public license (?:version |v )?v?1(?: 0)?
gpl-3.0 | gplv3 | gplv3
gpl-2.0 | gplv2 | gplv2
gpl-3.0 | gpl 3 | gpl 3(?: 0)?
gpl-2.0 | gpl 2 | gpl 2(?: 0)?
gpl-3.0-or-later | gpl 3 | gpl 3(?: 0)? or later
gpl-2.0-or-later | gpl 2 | gpl 2(?: 0)? or later
lgpl-2.1 | lesser general public license | (?:gnu )?lesser general public license (?:version |v )?v?2 1
lgpl-3.0 | lesser general public license | (?:gnu )?lesser general public license (?:version |v )?v?3(?: 0)?
lgpl-2.0 | library general public license | (?:gnu )?library general public license (?:version |v )?v?2(?: 0)?
lgpl-3.0 | lgplv3 | lgplv3
lgpl-2.1 | lgplv2 | lgplv2(?: 1)?
lgpl-2.1 | lgpl 2 | lgpl 2(?: 1)?
lgpl-3.0 | lgpl 3 | lgpl 3(?: 0)?
agpl-3.0 | affero general public license | (?:gnu )?affero general public license (?:version |v )?v?3(?: 0)?
agpl-3.0 | agplv3 | agplv3
agpl-3.0 | agpl 3 | agpl 3(?: 0)?
gfdl-1.3 | free documentation license | (?:gnu )?free documentation license (?:version |v )?1 3
gfdl-1.2 | free documentation license | (?:gnu )?free documentation license (?:version |v )?1 2
bsd-2-clause | 2 clause | (?:bsd 2 clause|2 clause bsd)(?: licen[cs]e)?
bsd-3-clause | 3 clause | (?:bsd 3 clause|3 clause bsd)(?: licen[cs]e)?
bsd-4-clause | 4 clause | (?:bsd 4 clause|4 clause bsd)(?: licen[cs]e)?
bsd-2-clause | simplified bsd | simplified bsd(?: licen[cs]e)?
bsd-3-clause | bsd | (?:modified|revised|new) bsd licen[cs]e
mpl-2.0 | mozilla public license | mozilla public license (?:version |v )?2 0
mpl-1.1 | mozilla public license | mozilla public license (?:version |v )?1 1
mpl-1.0 | mozilla public license | mozilla public license (?:version |v )?1 0
mpl-2.0 | mpl 2 0 | mpl 2 0
epl-1.0 | eclipse public license | eclipse public license (?:version |v )?1 0
epl-2.0 | eclipse public license | eclipse public license (?:version |v )?2 0
cpl-1.0 | common public license | common public license (?:version |v )?1 0
cddl-1.0 | cddl | cddl (?:version |v )?1 0
cddl-1.1 | cddl | cddl (?:version |v )?1 1
bsl-1.0 | boost software license | boost software license (?:version )?1 0
artistic-2.0 | artistic license 2 0 | artistic license 2 0
ofl-1.1 | open font license | (?:sil )?open font license (?:version )?1 1
eupl-1.2 | eupl | eupl (?:v )?1 2
eupl-1.1 | eupl | eupl (?:v )?1 1
osl-3.0 | open software license | open software license (?:version |v )?3 0
afl-3.0 | academic free license | academic free license (?:version |v )?3 0
cecill-2.1 | cecill | cecill (?:version |v )?2 1
ms-pl | microsoft public license | microsoft public license(?: ms pl)?
ms-rl | microsoft reciprocal license | microsoft reciprocal license(?: ms rl)?
cc0-1.0 | cc0 1 0 | cc0 1 0(?: universal)?
cc-by-4.0 | by 4 0 | cc by 4 0
cc-by-3.0 | by 3 0 | cc by 3 0
cc-by-2.0 | by 2 0 | cc by 2 0
cc-by-sa-4.0 | by sa 4 0 | cc by sa 4 0
cc-by-sa-3.0 | by sa 3 0 | cc by sa 3 0
cc-by-nc-4.0 | by nc 4 0 | cc by nc 4 0
cc-by-nc-3.0 | by nc 3 0 | cc by nc 3 0
cc-by-nd-4.0 | by nd 4 0 | cc by nd 4 0
cc-by-nc-sa-4.0 | by nc sa 4 0 | cc by nc sa 4 0
cc-by-nc-sa-3.0 | by nc sa 3 0 | cc by nc sa 3 0
cc-by-nc-nd-4.0 | by nc nd 4 0 | cc by nc nd 4 0
cc-by-4.0 | attribution 4 0 | (?:creative commons )?attribution 4 0(?: international)?
cc-by-sa-4.0 | attribution sharealike 4 0 | (?:creative commons )?attribution sharealike 4 0(?: international)?
cc-by-nc-4.0 | attribution noncommercial 4 0 | (?:creative commons )?attribution noncommercial 4 0(?: international)?
odbl-1.0 | open database license | open database license (?:version |v )?1 0
elastic-2.0 | elastic license 2 0 | elastic license 2 0
sspl-1.0 | server side public license | server side public license (?:version |v )?1(?: 0)?
bsl-1.1 | business source license | business source license (?:version )?1 1
python-2.0 | python software foundation license | python software foundation license(?: version)? 2
php-3.01 | php license | php license (?:version |v )?3 01
zpl-2.1 | zope public license | zope public license (?:zpl )?(?:version |v )?2 1
"""

#: Addresses of license texts.
ADDRESSES = r"""
apache-2.0 | apache org licenses | (?:www )?apache org licenses license 2 0
gpl-3.0 | gnu org licenses | (?:www )?gnu org licenses gpl 3 0(?: html)?
gpl-2.0 | gnu org licenses | (?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: html)?
lgpl-3.0 | gnu org licenses | (?:www )?gnu org licenses lgpl 3 0(?: html)?
agpl-3.0 | gnu org licenses | (?:www )?gnu org licenses agpl 3 0(?: html)?
gnu | gnu org licenses | (?:www )?gnu org licenses
mit | opensource org licenses mit | opensource org licenses mit(?: license)?
bsd-3-clause | opensource org licenses bsd | opensource org licenses bsd (?:3 clause|license)
mpl-2.0 | mozilla org mpl | (?:www )?mozilla org mpl (?:mpl )?2 0
cc0-1.0 | creativecommons org publicdomain | creativecommons org publicdomain zero 1 0
cc-by-4.0 | creativecommons org licenses by | creativecommons org licenses by 4 0
cc-by-sa-4.0 | creativecommons org licenses by sa | creativecommons org licenses by sa 4 0
cc-by-nc-4.0 | creativecommons org licenses by nc | creativecommons org licenses by nc 4 0
cc-by-nc-sa-4.0 | creativecommons org licenses by nc sa | creativecommons org licenses by nc sa 4 0
creative-commons | creativecommons org | creativecommons org licenses(?: [a-z]+){1,3}
unlicense | unlicense org | unlicense org
bsl-1.0 | boost org license | (?:www )?boost org license 1 0(?: txt)?
epl-2.0 | eclipse org legal | (?:www )?eclipse org legal epl 2 0
epl-1.0 | eclipse org legal | (?:www )?eclipse org legal epl v10(?: html)?
ofl-1.1 | scripts sil org ofl | scripts sil org ofl
wtfpl | wtfpl net | (?:www )?wtfpl net
"""

#: Names without a version.
NAMES = r"""
mit | mit licen | mit licen[cs]e
mit | expat licen | expat licen[cs]e
x11 | x11 licen | x11 licen[cs]e
apache | apache | apache(?: software)? licen[cs]e
gpl | general public licen | (?:gnu )?general public licen[cs]e
lgpl | lesser general public licen | (?:gnu )?lesser general public licen[cs]e
lgpl | library general public licen | (?:gnu )?library general public licen[cs]e
agpl | affero general public licen | (?:gnu )?affero general public licen[cs]e
gfdl | free documentation licen | (?:gnu )?free documentation licen[cs]e
gpl | gnu gpl | gnu gpl
lgpl | gnu lgpl | gnu lgpl
bsd | bsd | bsd(?: style)? licen[cs]e
isc | isc licen | isc licen[cs]e
mpl | mozilla public licen | mozilla public licen[cs]e
epl | eclipse public licen | eclipse public licen[cs]e
cpl | common public licen | common public licen[cs]e
cddl | common development and distribution licen | common development and distribution licen[cs]e
zlib | zlib licen | zlib licen[cs]e
bsl-1.0 | boost software licen | boost software licen[cs]e
artistic | artistic licen | artistic licen[cs]e
ofl | open font licen | (?:sil )?open font licen[cs]e
unlicense | the unlicense | the unlicense
wtfpl | wtfpl | wtfpl
beerware | beerware licen | beerware licen[cs]e
ncsa | ncsa licen | ncsa licen[cs]e
postgresql | postgresql licen | postgresql licen[cs]e
python | python licen | python licen[cs]e
python | python software foundation licen | python software foundation licen[cs]e
ruby | ruby licen | ruby licen[cs]e
php | php licen | php licen[cs]e
openssl | openssl licen | openssl licen[cs]e
json | json licen | json licen[cs]e
vim | vim licen | vim licen[cs]e
eupl | european union public licen | european union public licen[cs]e
osl | open software licen | open software licen[cs]e
afl | academic free licen | academic free licen[cs]e
cecill | cecill | cecill
ms-pl | ms pl | ms pl
elastic | elastic licen | elastic licen[cs]e
sspl | server side public licen | server side public licen[cs]e
bsl-1.1 | business source licen | business source licen[cs]e
odbl | open database licen | open database licen[cs]e
cc0 | cc0 | cc0
cc-by-nc | attribution noncommercial | (?:creative commons )?attribution noncommercial
cc-by-sa | attribution sharealike | (?:creative commons )?attribution sharealike
creative-commons | creative commons | creative commons(?: licen[cs]e)?
commons-clause | commons clause | commons clause
public-domain | public domain | public domain
"""

#: Words about licensing in general.
MENTIONS = r"""
all-rights-reserved | all rights reserved | all rights reserved
proprietary | proprietary licen | proprietary licen[cs]e
commercial | commercial licen | commercial licen[cs]e
dual-license | dual licen | dual licen[cs](?:ed|e|ing)
open-source | open source licen | open source licen[cs]e
free-software | free software licen | free software licen[cs]e
copyleft | copyleft | copyleft
royalty-free | royalty free licen | royalty free licen[cs]e
end-user-license | end user licen | end user licen[cs]e(?: agreement)?
see-license | license file | (?:see|in) (?:the )?(?:\S+ ){0,3}license file
"""

#: Levels from the strongest down, each with the confidence of its rules.
LEVELS = ((TEXTS, 0.98), (IDENTIFIERS, 0.97), (NOTICES, 0.93), (VERSIONS, 0.88), (ADDRESSES, 0.85), (NAMES, 0.7), (MENTIONS, 0.35))


#: Parts of many keywords: keywords that hold one are looked for only in texts that hold it too.
GATES = (
    "licen", "copy", "permission", "gpl", "bsd", "apache", "clause", "gnu", "public domain", "software", "creative",
    "attribution", "cc0", "wtfpl", "eupl", "cddl", "mpl", " 4 0", " 3 0", " 2 0",
)


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: str
    level: int


RULES = [Rule(*line.split(" | "), level) for level, (lines, _) in enumerate(LEVELS) for line in lines.strip().splitlines()]
CONFIDENCE = [c for _, c in LEVELS]
