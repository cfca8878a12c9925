"""License signatures over normalised words: lower case, one space between words.

Fixed values, one a line: label | priority | confidence in percent | expression.  Priority 0 is a
machine-readable tag, 1 wording of a license's own text, 2 a notice that grants a license, 3 a
full name, 4 a short mention.  An expression starts with a word, or a choice of words: it is
tried only where that word stands, and only in texts that hold one of ``KEYWORDS``, of which each
expression has one in what is not optional.
"""

from __future__ import annotations

import re

#: Words that an expression may span.
SPAN = 48

#: The prefilter of whole texts.
KEYWORDS = (
    "licen", "gpl", "public domain", "cc by", "cc0", "creative commons", "permission", "reserved", "vorbehalten", "réservés", "reservados", "redistribut", "warrant", "copyright",
    "copied", "mpl ", "epl ", "cddl", "eupl", "gfdl", "odbl", "wtfpl", "openrail", "bsd", "proprietary", "unauthorized", "as perl", "openssl project", "cryptographic software",
    "original software", "endorse or promote", "not evil", "a beer", "may not be called", "following acknowledg", "distributed under", "available under", "released under", "to copy modify",
)

SIGNATURES = """
mit | 0 | 99 | spdx licen[sc]e identifier mit
mit-0 | 0 | 99 | spdx licen[sc]e identifier mit 0
apache-2.0 | 0 | 99 | spdx licen[sc]e identifier apache 2 0
apache-1.1 | 0 | 99 | spdx licen[sc]e identifier apache 1 1
bsd-2-clause | 0 | 99 | spdx licen[sc]e identifier bsd 2 clause
bsd-3-clause | 0 | 99 | spdx licen[sc]e identifier bsd 3 clause
bsd-4-clause | 0 | 99 | spdx licen[sc]e identifier bsd 4 clause
0bsd | 0 | 99 | spdx licen[sc]e identifier 0bsd
gpl-2.0 | 0 | 99 | spdx licen[sc]e identifier gpl 2 0(?: only)?
gpl-2.0+ | 0 | 99 | spdx licen[sc]e identifier gpl 2 0 or later
gpl-3.0 | 0 | 99 | spdx licen[sc]e identifier gpl 3 0(?: only)?
gpl-3.0+ | 0 | 99 | spdx licen[sc]e identifier gpl 3 0 or later
lgpl-2.0 | 0 | 99 | spdx licen[sc]e identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 | 0 | 99 | spdx licen[sc]e identifier lgpl 2 1(?: only| or later)?
lgpl-3.0 | 0 | 99 | spdx licen[sc]e identifier lgpl 3 0(?: only| or later)?
agpl-3.0 | 0 | 99 | spdx licen[sc]e identifier agpl 3 0(?: only| or later)?
gfdl | 0 | 99 | spdx licen[sc]e identifier gfdl 1 [123](?: only| or later)?
mpl-1.1 | 0 | 99 | spdx licen[sc]e identifier mpl 1 1
mpl-2.0 | 0 | 99 | spdx licen[sc]e identifier mpl 2 0
epl-1.0 | 0 | 99 | spdx licen[sc]e identifier epl 1 0
epl-2.0 | 0 | 99 | spdx licen[sc]e identifier epl 2 0
cddl-1.0 | 0 | 99 | spdx licen[sc]e identifier cddl 1 0
cddl-1.1 | 0 | 99 | spdx licen[sc]e identifier cddl 1 1
eupl | 0 | 99 | spdx licen[sc]e identifier eupl 1 [12]
isc | 0 | 99 | spdx licen[sc]e identifier isc
zlib | 0 | 99 | spdx licen[sc]e identifier zlib
bsl-1.0 | 0 | 99 | spdx licen[sc]e identifier bsl 1 0
busl-1.1 | 0 | 99 | spdx licen[sc]e identifier busl 1 1
unlicense | 0 | 99 | spdx licen[sc]e identifier unlicense
wtfpl | 0 | 99 | spdx licen[sc]e identifier wtfpl
cc0-1.0 | 0 | 99 | spdx licen[sc]e identifier cc0 1 0
cc-by | 0 | 99 | spdx licen[sc]e identifier cc by [1-4] [05]
cc-by-sa | 0 | 99 | spdx licen[sc]e identifier cc by sa [1-4] [05]
cc-by-nd | 0 | 99 | spdx licen[sc]e identifier cc by nd [1-4] [05]
cc-by-nc | 0 | 99 | spdx licen[sc]e identifier cc by nc [1-4] [05]
cc-by-nc-sa | 0 | 99 | spdx licen[sc]e identifier cc by nc sa [1-4] [05]
cc-by-nc-nd | 0 | 99 | spdx licen[sc]e identifier cc by nc nd [1-4] [05]
artistic-2.0 | 0 | 99 | spdx licen[sc]e identifier artistic 2 0
artistic-1.0 | 0 | 99 | spdx licen[sc]e identifier artistic 1 0
ofl-1.1 | 0 | 99 | spdx licen[sc]e identifier ofl 1 1
odbl | 0 | 99 | spdx licen[sc]e identifier odbl 1 0
psf-2.0 | 0 | 99 | spdx licen[sc]e identifier p(?:sf|ython) 2 0
ncsa | 0 | 99 | spdx licen[sc]e identifier ncsa
postgresql | 0 | 99 | spdx licen[sc]e identifier postgresql
openssl | 0 | 99 | spdx licen[sc]e identifier openssl
ms-pl | 0 | 99 | spdx licen[sc]e identifier ms pl
sspl-1.0 | 0 | 99 | spdx licen[sc]e identifier sspl 1 0
mulanpsl-2.0 | 0 | 99 | spdx licen[sc]e identifier mulanpsl 2 0
upl-1.0 | 0 | 99 | spdx licen[sc]e identifier upl 1 0
ecl-2.0 | 0 | 99 | spdx licen[sc]e identifier ecl 2 0
mit | 1 | 98 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 1 | 96 | deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | 1 | 93 | copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 1 | 85 | software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit-0 | 1 | 90 | deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software
isc | 1 | 97 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
0bsd | 1 | 97 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software
historical-permission | 1 | 92 | permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee
postgresql | 1 | 93 | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
bsd | 1 | 95 | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | 1 | 93 | redistribution and use in source and binary forms with or without modification are permitted
bsd | 1 | 90 | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | 1 | 90 | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause | 1 | 96 | neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-3-clause | 1 | 90 | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | 1 | 97 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | 1 | 88 | provided by the (?:copyright holders?|regents|author)(?: and contributors)? as is and any express or implied warranties
apache-2.0 | 1 | 97 | you may not use this file except in compliance with the licen[sc]e
apache-2.0 | 1 | 94 | you may obtain a copy of the licen[sc]e at http www apache org licenses license 2 0
apache-2.0 | 1 | 90 | unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis
apache-2.0 | 1 | 96 | grant of patent licen[sc]e subject to the terms and conditions of this licen[sc]e each contributor hereby grants
apache-1.1 | 1 | 94 | products derived from this software may not be called apache nor may apache appear in their name
gpl | 1 | 90 | free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
gpl-2.0+ | 1 | 97 | free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 2
gpl-3.0+ | 1 | 97 | free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 3
gpl-2.0 | 1 | 97 | free software you can redistribute it and or modify it under the terms of (?:the gnu general public licen[sc]e )?version 2
lgpl | 1 | 91 | free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e
lgpl-2.1 | 1 | 97 | free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1
lgpl-3.0 | 1 | 97 | free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 3
agpl-3.0 | 1 | 96 | free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e
gpl | 1 | 86 | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:[^ ]+ )?general public licen[sc]e
gpl | 1 | 87 | received a copy of the gnu general public licen[sc]e along with this (?:program|file|software)
lgpl | 1 | 87 | received a copy of the gnu (?:lesser|library) general public licen[sc]e along with this (?:program|library|file|software)
agpl-3.0 | 1 | 90 | received a copy of the gnu affero general public licen[sc]e along with this (?:program|file|software)
gpl | 1 | 92 | everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document
gpl-3.0 | 1 | 93 | free copyleft licen[sc]e for software and other kinds of works
gpl-2.0 | 1 | 92 | licenses for most software are designed to take away your freedom to share and change it
agpl-3.0 | 1 | 94 | remote network interaction use with the gnu general public licen[sc]e
gfdl | 1 | 95 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e
mpl-2.0 | 1 | 97 | source code form is subject to the terms of the mozilla public licen[sc]e v 2 0
mpl-1.1 | 1 | 96 | subject to the mozilla public licen[sc]e version 1 1
mpl | 1 | 88 | file are subject to the mozilla public licen[sc]e
epl-1.0 | 1 | 95 | accompanying materials are made available under the terms of the eclipse public licen[sc]e v ?1 0
epl-2.0 | 1 | 95 | accompanying materials are made available under the terms of the eclipse public licen[sc]e v? ?2 0
cddl-1.0 | 1 | 94 | subject to the terms of the common development and distribution licen[sc]e
eupl | 1 | 94 | licensed under the eupl version 1 [12]
zlib | 1 | 95 | provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 1 | 93 | origin of this software must not be misrepresented you must not claim that you wrote the original software
bsl-1.0 | 1 | 95 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e
unlicense | 1 | 96 | free and unencumbered software released into the public domain
unlicense | 1 | 90 | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | 1 | 96 | do what the fuck you want to public licen[sc]e
cc0-1.0 | 1 | 95 | person who associated a work with this deed has dedicated the work to the public domain
cc0-1.0 | 1 | 92 | waived all copyright and related or neighbou?ring rights
cc-by | 1 | 88 | creative commons attribution [1-4] [05] international public licen[sc]e
cc-by-sa | 1 | 90 | creative commons attribution share ?alike [1-4] [05] international public licen[sc]e
ofl-1.1 | 1 | 95 | font software is licensed under the sil open font licen[sc]e
psf-2.0 | 1 | 95 | psf hereby grants licensee a nonexclusive royalty free world wide licen[sc]e
openssl | 1 | 93 | product includes software developed by the openssl project
ssleay | 1 | 92 | product includes cryptographic software written by eric young
artistic-1.0 | 1 | 90 | intent of this document is to state the conditions under which a package may be copied
ncsa | 1 | 92 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction
json | 1 | 95 | software shall be used for good not evil
beerware | 1 | 95 | buy me a beer in return
mulanpsl-2.0 | 1 | 94 | licensed under mulan psl v2
curl | 1 | 90 | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
mit | 2 | 95 | licen[sc]ed under (?:the )?(?:terms of (?:the )?)?mit(?: licen[sc]e)?
mit | 2 | 95 | released under (?:the )?(?:terms of (?:the )?)?mit(?: licen[sc]e)?
mit | 2 | 94 | distributed under (?:the )?(?:terms of (?:the )?)?mit(?: licen[sc]e)?
mit | 2 | 94 | available under (?:the )?(?:terms of (?:the )?)?mit(?: licen[sc]e)?
apache-2.0 | 2 | 96 | licen[sc]ed under (?:the )?(?:terms of (?:the )?)?apache (?:software )?licen[sc]e (?:version |v ?)?2 0
apache-2.0 | 2 | 96 | released under (?:the )?(?:terms of (?:the )?)?apache (?:software )?licen[sc]e (?:version |v ?)?2 0
apache-2.0 | 2 | 95 | distributed under (?:the )?(?:terms of (?:the )?)?apache (?:software )?licen[sc]e (?:version |v ?)?2 0
apache-2.0 | 2 | 95 | available under (?:the )?(?:terms of (?:the )?)?apache (?:software )?licen[sc]e (?:version |v ?)?2 0
apache | 2 | 90 | licen[sc]ed under (?:the )?(?:terms of (?:the )?)?apache (?:software )?licen[sc]e
apache | 2 | 90 | released under (?:the )?(?:terms of (?:the )?)?apache (?:software )?licen[sc]e
bsd-2-clause | 2 | 95 | licen[sc]ed under (?:the )?(?:terms of (?:the )?)?(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: licen[sc]e)?
bsd-3-clause | 2 | 95 | licen[sc]ed under (?:the )?(?:terms of (?:the )?)?(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: licen[sc]e)?
bsd | 2 | 90 | licen[sc]ed under (?:the )?(?:terms of (?:the )?)?bsd(?: style)?(?: licen[sc]e)?
bsd | 2 | 90 | released under (?:the |a )?(?:terms of (?:the )?)?bsd(?: style)?(?: licen[sc]e)?
gpl | 2 | 90 | licen[sc]ed under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:gpl|general public licen[sc]e)
gpl | 2 | 90 | released under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:gpl|general public licen[sc]e)
gpl | 2 | 90 | distributed under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:gpl|general public licen[sc]e)
gpl-2.0 | 2 | 95 | licen[sc]ed under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:gpl|general public licen[sc]e) ?(?:version |v ?)?2(?: 0)?
gpl-3.0 | 2 | 95 | licen[sc]ed under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:gpl|general public licen[sc]e) ?(?:version |v ?)?3(?: 0)?
gpl-2.0 | 2 | 95 | released under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:gpl|general public licen[sc]e) ?(?:version |v ?)?2(?: 0)?
gpl-3.0 | 2 | 95 | released under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:gpl|general public licen[sc]e) ?(?:version |v ?)?3(?: 0)?
lgpl | 2 | 91 | licen[sc]ed under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:lgpl|lesser general public licen[sc]e)
lgpl-2.1 | 2 | 95 | licen[sc]ed under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:lgpl|lesser general public licen[sc]e) ?(?:version |v ?)?2 1
lgpl-3.0 | 2 | 95 | licen[sc]ed under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:lgpl|lesser general public licen[sc]e) ?(?:version |v ?)?3(?: 0)?
agpl-3.0 | 2 | 95 | licen[sc]ed under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:agpl|affero general public licen[sc]e)(?: ?(?:version |v ?)?3(?: 0)?)?
mpl-2.0 | 2 | 95 | licen[sc]ed under (?:the )?(?:terms of (?:the )?)?(?:mpl|mozilla public licen[sc]e) (?:version |v ?)?2 0
epl-2.0 | 2 | 95 | licen[sc]ed under (?:the )?(?:terms of (?:the )?)?(?:epl|eclipse public licen[sc]e) (?:version |v ?)?2 0
epl-1.0 | 2 | 95 | licen[sc]ed under (?:the )?(?:terms of (?:the )?)?(?:epl|eclipse public licen[sc]e) (?:version |v ?)?1 0
isc | 2 | 94 | licen[sc]ed under (?:the )?(?:terms of (?:the )?)?isc licen[sc]e
cc-by | 2 | 93 | licen[sc]ed under (?:the |a )?(?:terms of (?:the )?)?(?:creative commons attribution|cc by)(?: [1-4] [05])?
cc-by-sa | 2 | 94 | licen[sc]ed under (?:the |a )?(?:terms of (?:the )?)?(?:creative commons attribution share ?alike|cc by sa)(?: [1-4] [05])?
cc-by-nc | 2 | 94 | licen[sc]ed under (?:the |a )?(?:terms of (?:the )?)?(?:creative commons attribution non ?commercial|cc by nc)(?: [1-4] [05])?
cc-by-nd | 2 | 94 | licen[sc]ed under (?:the |a )?(?:terms of (?:the )?)?(?:creative commons attribution no ?deriv(?:ative)?s|cc by nd)(?: [1-4] [05])?
cc-by-nc-sa | 2 | 95 | licen[sc]ed under (?:the |a )?(?:terms of (?:the )?)?(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: [1-4] [05])?
cc-by-nc-nd | 2 | 95 | licen[sc]ed under (?:the |a )?(?:terms of (?:the )?)?(?:creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd)(?: [1-4] [05])?
cc | 2 | 85 | licen[sc]ed under (?:the |a )?creative commons licen[sc]e
cc | 2 | 85 | text is available under (?:the )?creative commons
cc0-1.0 | 2 | 94 | released under (?:the )?(?:creative commons )?(?:cc0|cc zero)(?: 1 0)?
cc0-1.0 | 2 | 94 | licen[sc]ed under (?:the )?(?:creative commons )?(?:cc0|cc zero)(?: 1 0)?
public-domain | 2 | 88 | released (?:in|into|to) the public domain
public-domain | 2 | 88 | placed (?:in|into) the public domain
public-domain | 2 | 86 | dedicated to the public domain
perl | 2 | 93 | same terms as perl(?: 5)?(?: itself)?
php | 2 | 93 | subject to version [23] 0?1? ?of the php licen[sc]e
dual-mit-apache | 2 | 94 | dual licen[sc]ed under (?:the )?mit (?:licen[sc]e )?(?:and|or) (?:the )?apache
dual-mit-gpl | 2 | 94 | dual licen[sc]ed under (?:the )?mit (?:licen[sc]e )?(?:and|or) (?:the )?gpl
proprietary | 2 | 85 | unauthorized (?:copying|reproduction|use)(?: or distribution)? of this (?:file|software|document|material)
proprietary | 2 | 84 | proprietary and confidential
proprietary | 2 | 80 | may not be (?:copied|reproduced|redistributed)(?: or distributed)? without (?:the )?(?:prior |express )?(?:written )?permission
all-rights-reserved | 3 | 75 | all rights (?:are )?reserved
all-rights-reserved | 3 | 75 | alle rechte vorbehalten
all-rights-reserved | 3 | 75 | tous droits réservés
all-rights-reserved | 3 | 75 | todos los derechos reservados
mit | 3 | 80 | mit licen[sc]e
mit | 3 | 80 | mit expat licen[sc]e
mit-x11 | 3 | 80 | x11 licen[sc]e
mit-x11 | 3 | 82 | mit x11 licen[sc]e
apache-2.0 | 3 | 85 | apache (?:software )?licen[sc]e (?:version |v ?)?2(?: 0)?
apache-1.1 | 3 | 85 | apache (?:software )?licen[sc]e (?:version |v ?)?1 1
apache | 3 | 78 | apache (?:software )?licen[sc]e
bsd-2-clause | 3 | 85 | bsd 2 clause(?: licen[sc]e)?
bsd-3-clause | 3 | 85 | bsd 3 clause(?: licen[sc]e)?
bsd-4-clause | 3 | 85 | bsd 4 clause(?: licen[sc]e)?
bsd-2-clause | 3 | 82 | simplified bsd licen[sc]e
bsd-3-clause | 3 | 82 | (?:new|revised|modified) bsd licen[sc]e
bsd | 3 | 76 | bsd(?: style)? licen[sc]e
gpl | 3 | 80 | gnu general public licen[sc]e
gpl-2.0 | 3 | 86 | gnu general public licen[sc]e (?:version |v ?)2(?: 0)?
gpl-3.0 | 3 | 86 | gnu general public licen[sc]e (?:version |v ?)3(?: 0)?
gpl-2.0+ | 3 | 87 | gnu general public licen[sc]e (?:version |v ?)2(?: 0)? or (?:any )?later
gpl-3.0+ | 3 | 87 | gnu general public licen[sc]e (?:version |v ?)3(?: 0)? or (?:any )?later
lgpl | 3 | 80 | gnu (?:lesser|library) general public licen[sc]e
lgpl-2.0 | 3 | 85 | gnu library general public licen[sc]e (?:version |v ?)2(?: 0)?
lgpl-2.1 | 3 | 86 | gnu lesser general public licen[sc]e (?:version |v ?)2 1
lgpl-3.0 | 3 | 86 | gnu lesser general public licen[sc]e (?:version |v ?)3(?: 0)?
agpl-3.0 | 3 | 84 | gnu affero general public licen[sc]e(?: (?:version |v ?)3(?: 0)?)?
gfdl | 3 | 84 | gnu free documentation licen[sc]e
mpl-2.0 | 3 | 86 | mozilla public licen[sc]e (?:version |v ?)?2 0
mpl-1.1 | 3 | 86 | mozilla public licen[sc]e (?:version |v ?)?1 1
mpl | 3 | 78 | mozilla public licen[sc]e
epl-2.0 | 3 | 86 | eclipse public licen[sc]e (?:version |v ?)?2 0
epl-1.0 | 3 | 86 | eclipse public licen[sc]e (?:version |v ?)?1 0
epl | 3 | 78 | eclipse public licen[sc]e
cpl-1.0 | 3 | 82 | common public licen[sc]e(?: (?:version |v ?)?1 0)?
ipl-1.0 | 3 | 82 | ibm public licen[sc]e
apsl | 3 | 82 | apple public source licen[sc]e
cddl-1.0 | 3 | 82 | common development and distribution licen[sc]e
eupl | 3 | 82 | european union public licen[sc]e
isc | 3 | 80 | isc licen[sc]e
zlib | 3 | 80 | zlib(?: libpng)? licen[sc]e
artistic-2.0 | 3 | 84 | artistic licen[sc]e (?:version )?2 0
artistic | 3 | 78 | artistic licen[sc]e
bsl-1.0 | 3 | 82 | boost software licen[sc]e(?: (?:version )?1 0)?
busl-1.1 | 3 | 82 | business source licen[sc]e(?: 1 1)?
sspl-1.0 | 3 | 82 | server side public licen[sc]e
elastic-2.0 | 3 | 82 | elastic licen[sc]e(?: 2 0)?
ofl-1.1 | 3 | 84 | sil open font licen[sc]e(?: (?:version )?1 1)?
odbl | 3 | 82 | open database licen[sc]e
odc-by | 3 | 82 | open data commons attribution licen[sc]e
pddl | 3 | 82 | public domain dedication and licen[sc]e
psf-2.0 | 3 | 82 | python software foundation licen[sc]e
php | 3 | 82 | php licen[sc]e(?: version)? 3 0?1?
ruby | 3 | 80 | ruby licen[sc]e
postgresql | 3 | 80 | postgresql licen[sc]e
openssl | 3 | 80 | openssl licen[sc]e
ncsa | 3 | 80 | university of illinois ncsa open source licen[sc]e
w3c | 3 | 82 | w3c software (?:notice and )?licen[sc]e
vim | 3 | 80 | vim licen[sc]e
wtfpl | 3 | 82 | wtfpl
unlicense | 3 | 80 | unlicense
ms-pl | 3 | 82 | microsoft public licen[sc]e
ms-rl | 3 | 82 | microsoft reciprocal licen[sc]e
upl-1.0 | 3 | 82 | universal permissive licen[sc]e
afl-3.0 | 3 | 82 | academic free licen[sc]e(?: (?:version |v ?)?3 0)?
osl-3.0 | 3 | 82 | open software licen[sc]e(?: (?:version |v ?)?3 0)?
ecl-2.0 | 3 | 82 | educational community licen[sc]e
llama | 3 | 80 | llama [23](?: [1-3])? community licen[sc]e
openrail | 3 | 80 | openrail(?: m)?(?: licen[sc]e)?
cc-by | 3 | 82 | creative commons attribution(?: [1-4] [05])?(?: international| unported)?
cc-by-sa | 3 | 84 | creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?
cc-by-nc | 3 | 84 | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?
cc-by-nd | 3 | 84 | creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported)?
cc-by-nc-sa | 3 | 85 | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?
cc-by-nc-nd | 3 | 85 | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported)?
cc0-1.0 | 3 | 84 | creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?
cc | 3 | 70 | creative commons licen[sc]e
cc0-1.0 | 4 | 75 | cc0(?: 1 0)?(?: universal)?
cc-by | 4 | 72 | cc by(?: [1-4] [05])?
cc-by-sa | 4 | 74 | cc by sa(?: [1-4] [05])?
cc-by-nc | 4 | 74 | cc by nc(?: [1-4] [05])?
cc-by-nd | 4 | 74 | cc by nd(?: [1-4] [05])?
cc-by-nc-sa | 4 | 75 | cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd | 4 | 75 | cc by nc nd(?: [1-4] [05])?
gpl | 4 | 65 | gpl
gpl-2.0 | 4 | 75 | gpl (?:version |v ?)?2(?: 0)?
gpl-3.0 | 4 | 75 | gpl (?:version |v ?)?3(?: 0)?
gpl-2.0 | 4 | 75 | gplv2
gpl-3.0 | 4 | 75 | gplv3
gpl | 4 | 68 | gnu gpl
gpl-2.0 | 4 | 76 | gnu gpl ?(?:version |v ?)?2(?: 0)?
gpl-3.0 | 4 | 76 | gnu gpl ?(?:version |v ?)?3(?: 0)?
lgpl | 4 | 66 | lgpl
lgpl-2.1 | 4 | 75 | lgpl (?:version |v ?)?2 1
lgpl-3.0 | 4 | 75 | lgpl (?:version |v ?)?3(?: 0)?
lgpl-2.1 | 4 | 75 | lgplv2 1
lgpl-3.0 | 4 | 75 | lgplv3
agpl-3.0 | 4 | 74 | agpl(?: (?:version |v ?)?3(?: 0)?)?
agpl-3.0 | 4 | 75 | agplv3
mpl-2.0 | 4 | 72 | mpl (?:version |v ?)?2 0
mpl-1.1 | 4 | 72 | mpl (?:version |v ?)?1 1
epl-2.0 | 4 | 72 | epl (?:version |v ?)?2 0
cddl | 4 | 70 | cddl(?: (?:version |v ?)?1 [01])?
eupl | 4 | 70 | eupl(?: (?:version |v ?)?1 [12])?
gfdl | 4 | 70 | gfdl(?: 1 [123])?
odbl | 4 | 70 | odbl
public-domain | 4 | 60 | public domain
""".strip()


def first_words(expression: str) -> list[str]:
    """The words that an expression may start with."""
    token = re.match(r"\(\?:[^()]*\)|[^ (?]+", expression)[0]
    choices = token[3:-1].split("|") if token.startswith("(?:") else [token]
    return sorted({c.replace("[sc]", x) for c in choices for x in ("sc" if "[sc]" in c else "-")})


def keyword_of(expression: str) -> str:
    """The first of ``KEYWORDS`` in the part of an expression that every match has; empty if there is none."""
    sure = re.sub(r"\[[^\]]*\]", "", re.sub(r"\(\?:[^()]*\)[?*]?(?:\{[^}]*\})?", "|", re.sub(r"\(\?:(?:[^()]|\(\?:[^()]*\)\??)*\)\?", "|", expression)))
    sure = re.sub(r".\?", "|", sure)
    return next((k for k in KEYWORDS if k in f"{sure} "), "")


def signature_rules() -> list[tuple[int, int, float, str, tuple[str, ...], str]]:
    """(order, priority, confidence, label, keywords, expression), best priority first, then as listed."""
    rows = [[x.strip() for x in line.split(" | ")] for line in SIGNATURES.split("\n")]
    rows.sort(key=lambda r: int(r[1]))
    return [(i, int(p), int(c) / 100, label, tuple(first_words(rx)), rx) for i, (label, p, c, rx) in enumerate(rows)]
