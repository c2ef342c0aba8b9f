"""Hand-written license signatures, in order of priority.

A rule is `label | keyword | weight | pattern`. Patterns see the text's words (runs of digits, a-z and non-ASCII characters),
joined by one blank; `^` and `$` stand for the edge of a word. The keyword must occur in the lower-cased text before the
pattern is tried. Earlier rules win over later ones.
"""

from __future__ import annotations

import re

BASE_PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Tags of the form "SPDX-License-Identifier: X" come first: they name their license exactly.
SPDX = r"""
apache-2.0 | spdx | 1.0 | spdx license identifier apache 2 0
mit-0 | spdx | 1.0 | spdx license identifier mit 0
mit | spdx | 1.0 | spdx license identifier mit
agpl-3.0-or-later | spdx | 1.0 | spdx license identifier agpl 3 0 or later
agpl-3.0 | spdx | 1.0 | spdx license identifier agpl 3 0( only)?
lgpl-3.0-or-later | spdx | 1.0 | spdx license identifier lgpl 3 0 or later
lgpl-3.0 | spdx | 1.0 | spdx license identifier lgpl 3 0( only)?
lgpl-2.1-or-later | spdx | 1.0 | spdx license identifier lgpl 2 1 or later
lgpl-2.1 | spdx | 1.0 | spdx license identifier lgpl 2 1( only)?
gpl-3.0-or-later | spdx | 1.0 | spdx license identifier gpl 3 0 or later
gpl-3.0 | spdx | 1.0 | spdx license identifier gpl 3 0( only)?
gpl-2.0-or-later | spdx | 1.0 | spdx license identifier gpl 2 0 or later
gpl-2.0 | spdx | 1.0 | spdx license identifier gpl 2 0( only)?
bsd-2-clause | spdx | 1.0 | spdx license identifier bsd 2 clause
bsd-3-clause-clear | spdx | 1.0 | spdx license identifier bsd 3 clause clear
bsd-3-clause | spdx | 1.0 | spdx license identifier bsd 3 clause
bsd-4-clause | spdx | 1.0 | spdx license identifier bsd 4 clause
0bsd | spdx | 1.0 | spdx license identifier 0bsd
isc | spdx | 1.0 | spdx license identifier isc
zlib | spdx | 1.0 | spdx license identifier zlib
bsl-1.0 | spdx | 1.0 | spdx license identifier bsl 1 0
mpl-2.0 | spdx | 1.0 | spdx license identifier mpl 2 0
mpl-1.1 | spdx | 1.0 | spdx license identifier mpl 1 1
epl-2.0 | spdx | 1.0 | spdx license identifier epl 2 0
epl-1.0 | spdx | 1.0 | spdx license identifier epl 1 0
eupl-1.2 | spdx | 1.0 | spdx license identifier eupl 1 2
cddl-1.0 | spdx | 1.0 | spdx license identifier cddl 1 0
unlicense | spdx | 1.0 | spdx license identifier unlicense
wtfpl | spdx | 1.0 | spdx license identifier wtfpl
cc0-1.0 | spdx | 1.0 | spdx license identifier cc0 1 0
cc-by-4.0 | spdx | 1.0 | spdx license identifier cc by 4 0
cc-by-sa-4.0 | spdx | 1.0 | spdx license identifier cc by sa 4 0
cc-by-nc-4.0 | spdx | 1.0 | spdx license identifier cc by nc 4 0
artistic-2.0 | spdx | 1.0 | spdx license identifier artistic 2 0
ofl-1.1 | spdx | 1.0 | spdx license identifier ofl 1 1
ms-pl | spdx | 1.0 | spdx license identifier ms pl
ms-rl | spdx | 1.0 | spdx license identifier ms rl
postgresql | spdx | 1.0 | spdx license identifier postgresql
python-2.0 | spdx | 1.0 | spdx license identifier (python 2 0|psf 2 0)
busl-1.1 | spdx | 1.0 | spdx license identifier busl 1 1
sspl-1.0 | spdx | 1.0 | spdx license identifier sspl 1 0
elastic-2.0 | spdx | 1.0 | spdx license identifier elastic 2 0
"""

#: Addresses of license texts.
ADDRESSES = r"""
apache-2.0 | apache | 0.95 | (www )?apache org licenses license 2 0
apache-1.1 | apache | 0.95 | (www )?apache org licenses license 1 1
apache-1.0 | apache | 0.95 | (www )?apache org licenses license 1 0
gpl-3.0 | gnu | 0.9 | gnu org licenses gpl 3 0
gpl-2.0 | gnu | 0.9 | gnu org licenses (old licenses )?gpl 2 0
gpl | gnu | 0.8 | gnu org licenses gpl
lgpl-3.0 | gnu | 0.9 | gnu org licenses lgpl 3 0
lgpl-2.1 | gnu | 0.9 | gnu org licenses (old licenses )?lgpl 2 1
lgpl | gnu | 0.8 | gnu org licenses lgpl
agpl-3.0 | gnu | 0.9 | gnu org licenses agpl 3 0
gfdl-1.3 | gnu | 0.9 | gnu org licenses fdl 1 3
gfdl | gnu | 0.8 | gnu org licenses fdl
gpl | gnu | 0.7 | gnu org copyleft gpl
mit | opensource | 0.95 | opensource org licenses? mit
bsd-2-clause | opensource | 0.95 | opensource org licenses? bsd 2 clause
bsd-3-clause | opensource | 0.95 | opensource org licenses? bsd 3 clause
isc | opensource | 0.95 | opensource org licenses? isc
mpl-2.0 | opensource | 0.95 | opensource org licenses? mpl 2 0
artistic-2.0 | opensource | 0.95 | opensource org licenses? artistic 2 0
ms-pl | opensource | 0.95 | opensource org licenses? ms pl
apache-2.0 | opensource | 0.95 | opensource org licenses? apache 2 0
gpl-3.0 | opensource | 0.9 | opensource org licenses? gpl 3 0
gpl-2.0 | opensource | 0.9 | opensource org licenses? gpl 2 0
epl-2.0 | opensource | 0.9 | opensource org licenses? epl 2 0
mpl-2.0 | mozilla | 0.95 | mozilla org (en us )?mpl 2 0
mpl-1.1 | mozilla | 0.95 | mozilla org (en us )?mpl 1 1
epl-1.0 | eclipse | 0.95 | eclipse org (org )?(legal|documents) epl v10
epl-2.0 | eclipse | 0.95 | eclipse org (org )?(legal|documents) epl (v20|2 0)
bsl-1.0 | boost | 0.95 | boost org license 1 0
unlicense | unlicense | 0.95 | unlicense org
wtfpl | wtfpl | 0.95 | wtfpl net
ofl-1.1 | scripts | 0.9 | scripts sil org ofl
cc-by-nc-nd-4.0 | creativecommons | 0.95 | creativecommons org licenses by nc nd 4 0
cc-by-nc-sa-4.0 | creativecommons | 0.95 | creativecommons org licenses by nc sa 4 0
cc-by-nd-4.0 | creativecommons | 0.95 | creativecommons org licenses by nd 4 0
cc-by-sa-4.0 | creativecommons | 0.95 | creativecommons org licenses by sa 4 0
cc-by-nc-4.0 | creativecommons | 0.95 | creativecommons org licenses by nc 4 0
cc-by-4.0 | creativecommons | 0.95 | creativecommons org licenses by 4 0
cc-by-nc-nd-3.0 | creativecommons | 0.95 | creativecommons org licenses by nc nd 3 0
cc-by-nc-sa-3.0 | creativecommons | 0.95 | creativecommons org licenses by nc sa 3 0
cc-by-nd-3.0 | creativecommons | 0.95 | creativecommons org licenses by nd 3 0
cc-by-sa-3.0 | creativecommons | 0.95 | creativecommons org licenses by sa 3 0
cc-by-nc-3.0 | creativecommons | 0.95 | creativecommons org licenses by nc 3 0
cc-by-3.0 | creativecommons | 0.95 | creativecommons org licenses by 3 0
cc-by-sa-2.0 | creativecommons | 0.9 | creativecommons org licenses by sa 2 [05]
cc-by-2.0 | creativecommons | 0.9 | creativecommons org licenses by 2 [05]
cc-by-nc-nd | creativecommons | 0.85 | creativecommons org licenses by nc nd
cc-by-nc-sa | creativecommons | 0.85 | creativecommons org licenses by nc sa
cc-by-nd | creativecommons | 0.85 | creativecommons org licenses by nd
cc-by-sa | creativecommons | 0.85 | creativecommons org licenses by sa
cc-by-nc | creativecommons | 0.85 | creativecommons org licenses by nc
cc-by | creativecommons | 0.85 | creativecommons org licenses by
cc0-1.0 | creativecommons | 0.95 | creativecommons org publicdomain zero 1 0
public-domain | creativecommons | 0.9 | creativecommons org publicdomain mark
cc | creativecommons | 0.6 | creativecommons org licenses?
"""

#: Phrases that occur in one license's text only.
BODIES = r"""
apache-2.0 | apache | 1.0 | licensed under the apache license version 2 0
apache-2.0 | unless required | 0.9 | unless required by applicable law or agreed to in writing software distributed under the license
apache-1.1 | apache software foundation | 0.9 | this product includes software developed by the apache software foundation
mit | free of charge | 1.0 | permission is hereby granted free of charge to any person obtaining a copy
mit | as is | 0.85 | the software is provided as is without warranty of any kind express or implied
x11 | x consortium | 0.9 | except as contained in this notice the name of the x consortium
isc | with or without fee | 0.95 | permission to use copy modify and or distribute this software for any purpose with or without fee
bsd-4-clause | advertising | 0.95 | all advertising materials mentioning features or use of this software must display
bsd-3-clause | endorse | 0.95 | neither the names? of .{1,200}? may be used to endorse or promote products
bsd | redistribution | 0.85 | redistribution and use in source and binary forms with or without modification are permitted
zlib | altered source | 0.95 | altered source versions must be plainly marked as such
libpng | png reference | 0.95 | the png reference library is supplied as is
gpl-3.0-or-later | version 3 | 1.0 | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0-or-later | version 2 | 1.0 | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-2.0 | version 2 | 0.95 | gnu general public license as published by the free software foundation version 2
gpl-3.0 | version 3 | 0.95 | gnu general public license as published by the free software foundation version 3
gpl | general public | 0.8 | gnu general public license as published by the free software foundation
lgpl-2.1-or-later | lesser | 1.0 | gnu lesser general public license as published by the free software foundation either version 2 1 of the license
lgpl-3.0-or-later | lesser | 1.0 | gnu lesser general public license as published by the free software foundation either version 3 of the license
agpl-3.0-or-later | affero | 1.0 | gnu affero general public license as published by the free software foundation either version 3 of the license
gpl | general public | 0.8 | this program is distributed in the hope that it will be useful but without any warranty
gpl | free software | 0.7 | this program is free software you can redistribute it and or modify it
lgpl | free software | 0.7 | this library is free software you can redistribute it and or modify it
gfdl | front cover texts | 0.95 | with no invariant sections (with )?no front cover texts
mpl-2.0 | mozilla | 1.0 | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | mozilla | 0.95 | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0 | mozilla | 0.95 | the contents of this file are subject to the mozilla public license version 1 0
npl-1.1 | netscape | 0.95 | the contents of this file are subject to the netscape public license version 1 1
cddl-1.0 | common development | 0.95 | the contents of this file are subject to the terms of the common development and distribution license
epl-2.0 | eclipse | 0.95 | made available under the terms of the eclipse public license 2 0
epl-1.0 | eclipse | 0.95 | made available under the terms of the eclipse public license v1 0
cpl-1.0 | common public | 0.95 | made available under the terms of the common public license v1 0
unlicense | public domain | 1.0 | this is free and unencumbered software released into the public domain
wtfpl | what the fuck | 1.0 | do what the fuck you want to public license
beerware | beer | 0.95 | you can buy me a beer in return
json | good not evil | 1.0 | the software shall be used for good not evil
bsl-1.0 | boost | 0.95 | distributed under the boost software license version 1 0
boost-body | executable form | 0.8 | machine executable object code generated by a source language processor
ofl-1.1 | reserved font | 0.95 | reserved font names?
artistic-2.0 | artistic | 0.95 | under the terms of the artistic license 2 0
artistic-1.0 | artistic | 0.85 | under the (same )?terms (as|of) (perl itself|the artistic license)
perl | perl itself | 0.9 | under the same terms as perl itself
python-2.0 | python software | 0.9 | python software foundation license
cc0-1.0 | waived | 0.9 | has waived all copyright and related or neighboring rights
public-domain | public domain | 0.8 | (placed|dedicated|released|put) (in|to|into) the public domain
public-domain | public domain | 0.7 | is in the public domain
proprietary | all rights | 0.6 | all rights reserved
proprietary | confidential | 0.7 | confidential and proprietary
proprietary | unauthorized | 0.7 | unauthorized (copying|use|distribution|reproduction) (of .{1,80}? )?is (strictly )?prohibited
non-commercial | commercial | 0.7 | (for )?non ?commercial (use|purposes) only
evaluation-only | evaluation | 0.6 | for evaluation purposes only
"""

#: Names with a version, then names alone.
NAMES = r"""
apache-2.0 | apache | 0.9 | apache (software )?licen[cs]e( version)? v?2( 0)?
apache-1.1 | apache | 0.9 | apache (software )?licen[cs]e( version)? v?1 1
apache-1.0 | apache | 0.9 | apache (software )?licen[cs]e( version)? v?1 0
apache | apache | 0.7 | apache (software )?licen[cs]e
apache-2.0 | asl | 0.6 | asl (v )?2 0
mit-0 | mit | 0.9 | mit no attribution( license)?
mit | mit | 0.8 | (the )?mit licen[cs]e
mit | expat | 0.8 | expat licen[cs]e
x11 | x11 | 0.8 | x11 licen[cs]e
agpl-3.0 | affero | 0.95 | (gnu )?affero general public licen[cs]e( version)? v?3( 0)?
agpl-1.0 | affero | 0.9 | affero general public licen[cs]e( version)? v?1( 0)?
agpl | affero | 0.8 | (gnu )?affero general public licen[cs]e
lgpl-3.0 | lesser | 0.95 | (gnu )?lesser general public licen[cs]e( version)? v?3( 0)?
lgpl-2.1 | lesser | 0.95 | (gnu )?lesser general public licen[cs]e( version)? v?2 1
lgpl | lesser | 0.8 | (gnu )?lesser general public licen[cs]e
lgpl-2.0 | library | 0.9 | (gnu )?library general public licen[cs]e( version)? v?2( 0)?
lgpl-2.0 | library | 0.8 | (gnu )?library general public licen[cs]e
gpl-3.0 | general public | 0.95 | (gnu )?general public licen[cs]e( version)? v?3( 0)?
gpl-2.0 | general public | 0.95 | (gnu )?general public licen[cs]e( version)? v?2( 0)?
gpl-1.0 | general public | 0.9 | (gnu )?general public licen[cs]e( version)? v?1( 0)?
gpl | general public | 0.8 | (gnu )?general public licen[cs]e
agpl-3.0 | agpl | 0.8 | agpl ?v?3( 0)?
agpl | agpl | 0.6 | (gnu )?agpl
lgpl-3.0 | lgpl | 0.8 | lgpl ?v?3( 0)?
lgpl-2.1 | lgpl | 0.8 | lgpl ?v?2 1
lgpl | lgpl | 0.6 | (gnu )?lgpl
gpl-3.0-or-later | gpl | 0.85 | gpl ?v?3( 0)? or later
gpl-2.0-or-later | gpl | 0.85 | gpl ?v?2( 0)? or later
gpl-3.0 | gpl | 0.8 | gpl ?v?3( 0)?
gpl-2.0 | gpl | 0.8 | gpl ?v?2( 0)?
gpl | gpl | 0.5 | (gnu )?gpl
gfdl-1.3 | free documentation | 0.95 | (gnu )?free documentation licen[cs]e( version)? 1 3
gfdl-1.2 | free documentation | 0.95 | (gnu )?free documentation licen[cs]e( version)? 1 2
gfdl-1.1 | free documentation | 0.95 | (gnu )?free documentation licen[cs]e( version)? 1 1
gfdl | free documentation | 0.8 | (gnu )?free documentation licen[cs]e
bsd-4-clause | bsd | 0.9 | (original|old|4 clause|four clause) bsd( licen[cs]e)?
bsd-3-clause | bsd | 0.9 | (new|modified|revised|3 clause|three clause) bsd( licen[cs]e)?
bsd-2-clause | bsd | 0.9 | (simplified|freebsd|2 clause|two clause) bsd( licen[cs]e)?
0bsd | bsd | 0.9 | (zero clause|0 clause) bsd( licen[cs]e)?
bsd-3-clause | bsd | 0.85 | bsd 3 clause
bsd-2-clause | bsd | 0.85 | bsd 2 clause
0bsd | 0bsd | 0.7 | 0bsd
bsd | bsd | 0.7 | bsd( style)? licen[cs]e
isc | isc | 0.8 | isc licen[cs]e
zlib | zlib | 0.8 | zlib( libpng)? licen[cs]e
libpng | libpng | 0.8 | libpng licen[cs]e
bzip2 | bzip2 | 0.7 | bzip2 licen[cs]e
openssl | openssl | 0.8 | openssl licen[cs]e
ssleay | ssleay | 0.8 | ssleay licen[cs]e
curl | curl | 0.7 | curl licen[cs]e
mpl-2.0 | mozilla | 0.95 | mozilla public licen[cs]e( version)? v?2( 0)?
mpl-1.1 | mozilla | 0.95 | mozilla public licen[cs]e( version)? v?1 1
mpl-1.0 | mozilla | 0.95 | mozilla public licen[cs]e( version)? v?1 0
mpl | mozilla | 0.8 | mozilla public licen[cs]e
npl | netscape | 0.8 | netscape public licen[cs]e
epl-2.0 | eclipse | 0.95 | eclipse public licen[cs]e( version)? v?2( 0)?
epl-1.0 | eclipse | 0.95 | eclipse public licen[cs]e( version)? v?1( 0)?
epl | eclipse | 0.8 | eclipse public licen[cs]e
edl-1.0 | eclipse | 0.9 | eclipse distribution licen[cs]e( version)?( v?1 0)?
cpl-1.0 | common public | 0.8 | common public licen[cs]e
cpal-1.0 | attribution | 0.9 | common public attribution licen[cs]e
ipl-1.0 | ibm | 0.9 | ibm public licen[cs]e
cddl-1.1 | common development | 0.95 | common development and distribution licen[cs]e( version)? v?1 1
cddl-1.0 | common development | 0.9 | common development and distribution licen[cs]e
cddl | cddl | 0.6 | cddl
eupl-1.2 | european union | 0.95 | european union public licen[cs]e( version)? v?1 2
eupl-1.1 | european union | 0.95 | european union public licen[cs]e( version)? v?1 1
eupl | european union | 0.8 | european union public licen[cs]e
eupl | eupl | 0.7 | eupl
osl-3.0 | open software | 0.9 | open software licen[cs]e( version)? v?3 0
osl | open software | 0.8 | open software licen[cs]e
afl-3.0 | academic free | 0.9 | academic free licen[cs]e( version)? v?3 0
afl | academic free | 0.8 | academic free licen[cs]e
artistic-2.0 | artistic | 0.9 | artistic licen[cs]e( version)? v?2( 0)?
artistic-1.0 | artistic | 0.7 | artistic licen[cs]e
bsl-1.0 | boost | 0.9 | boost software licen[cs]e
ms-pl | microsoft | 0.9 | microsoft public licen[cs]e
ms-rl | microsoft | 0.9 | microsoft reciprocal licen[cs]e
apsl-2.0 | apple | 0.9 | apple public source licen[cs]e
qpl-1.0 | q public | 0.9 | q public licen[cs]e
php-3.01 | php | 0.8 | php licen[cs]e
python-2.0 | python | 0.8 | (python|psf) licen[cs]e
ruby | ruby | 0.8 | ruby licen[cs]e
postgresql | postgresql | 0.8 | postgresql licen[cs]e
unicode | unicode | 0.7 | unicode licen[cs]e( agreement)?
w3c | w3c | 0.8 | w3c( software)?( notice and)? licen[cs]e
ncsa | ncsa | 0.8 | (university of illinois )?ncsa( open source)? licen[cs]e
upl-1.0 | universal permissive | 0.9 | universal permissive licen[cs]e
vim | vim | 0.7 | vim licen[cs]e
wtfpl | wtfpl | 0.8 | wtfpl
unlicense | unlicense | 0.8 | (the )?unlicense
beerware | beer | 0.8 | beer ?ware licen[cs]e
ofl-1.1 | open font | 0.9 | (sil )?open font licen[cs]e( version)?( 1 1)?
odbl-1.0 | open database | 0.9 | open (data commons open )?database licen[cs]e
odc-by-1.0 | data commons | 0.9 | open data commons attribution licen[cs]e
pddl-1.0 | public domain dedication | 0.9 | public domain dedication and licen[cs]e
busl-1.1 | business source | 0.9 | business source licen[cs]e
sspl-1.0 | server side | 0.9 | server side public licen[cs]e
elastic-2.0 | elastic | 0.9 | elastic licen[cs]e
commons-clause | commons clause | 0.9 | commons clause
polyform | polyform | 0.8 | polyform (noncommercial|shield|strict|small business|perimeter)
openrail | rail | 0.8 | (creativeml )?open ?rail( m)?( licen[cs]e)?
llama | llama | 0.8 | llama [0-9]+ community licen[cs]e
cecill-2.1 | cecill | 0.9 | cecill( licen[cs]e)?( version)? v?2 1
cecill-b | cecill | 0.8 | cecill b
cecill-c | cecill | 0.8 | cecill c
cecill | cecill | 0.7 | cecill
ogl | open government | 0.9 | open government licen[cs]e
cc0-1.0 | cc0 | 0.9 | cc0( 1 0)?( universal)?
cc-by-nc-nd | attribution | 0.9 | creative commons attribution non ?commercial no ?deriv(ative|ative works|atives|s)?
cc-by-nc-sa | attribution | 0.9 | creative commons attribution non ?commercial share ?alike
cc-by-nc | attribution | 0.9 | creative commons attribution non ?commercial
cc-by-nd | attribution | 0.9 | creative commons attribution no ?deriv(ative|ative works|atives|s)?
cc-by-sa-4.0 | attribution | 0.95 | creative commons attribution share ?alike 4 0
cc-by-sa-3.0 | attribution | 0.95 | creative commons attribution share ?alike 3 0
cc-by-sa | attribution | 0.9 | creative commons attribution share ?alike
cc-by-4.0 | attribution | 0.95 | creative commons attribution( licen[cs]e)? 4 0
cc-by-3.0 | attribution | 0.95 | creative commons attribution( licen[cs]e)? 3 0
cc-by | attribution | 0.85 | creative commons attribution( licen[cs]e)?
cc-by-nc-nd-4.0 | cc | 0.9 | cc by nc nd 4 0
cc-by-nc-sa-4.0 | cc | 0.9 | cc by nc sa 4 0
cc-by-sa-4.0 | cc | 0.9 | cc by sa 4 0
cc-by-nc-4.0 | cc | 0.9 | cc by nc 4 0
cc-by-nd-4.0 | cc | 0.9 | cc by nd 4 0
cc-by-4.0 | cc | 0.9 | cc by 4 0
cc-by-sa-3.0 | cc | 0.9 | cc by sa 3 0
cc-by-3.0 | cc | 0.9 | cc by 3 0
cc-by-nc-nd | cc | 0.75 | cc by nc nd
cc-by-nc-sa | cc | 0.75 | cc by nc sa
cc-by-nc | cc | 0.75 | cc by nc
cc-by-nd | cc | 0.75 | cc by nd
cc-by-sa | cc | 0.75 | cc by sa
cc-by | cc | 0.6 | cc by
cc | creative commons | 0.5 | creative commons( licen[cs]e)?
"""


def rules() -> list[tuple[str, str, float, re.Pattern]]:
    out = []
    for line in (SPDX + ADDRESSES + BODIES + NAMES).splitlines():
        if line.strip():
            label, keyword, weight, pattern = (x.strip() for x in line.split(" | ", 3))
            out.append((label, keyword, float(weight), re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])")))
    return out
