"""The ordered signature rules of the license scan.

One rule a line: label | keyword | expression, in blocks by priority. Texts are
words of lower-case letters and digits with one space between them, so `2.0` is
`2 0`; `~` stands for an optional few words. A rule's keyword is part of
whatever it matches.
"""

from __future__ import annotations

#: Whole notices and tags: they decide over what they contain.
_NOTICES = """
apache-2.0 | apache | licensed under the apache license version 2 0(?: the license)?
apache-2.0 | apache | apache license version 2 0 january 2004
apache-2.0 | apache | you may obtain a copy of the license at (?:https? )?(?:www )?apache org licenses license 2 0
apache-2.0 | apache | licensed to the apache software foundation asf under one or more contributor license agreements
apache-2.0 | spdx | spdx license identifier apache 2 0
apache-1.1 | apache | apache software license version 1 1
apache-1.0 | apache | this product includes software developed by the apache group for use in the apache http server project
mit | permission | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | merchantability | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit | spdx | spdx license identifier mit
mit | released under | released under the mit license
mit | licensed under | licensed under the mit license
mit-0 | spdx | spdx license identifier mit 0
isc | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | spdx | spdx license identifier isc
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that
bsd-3-clause | endorse | neither the name of ~nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-2-clause | spdx | spdx license identifier bsd 2 clause
bsd-3-clause | spdx | spdx license identifier bsd 3 clause
bsd-4-clause | spdx | spdx license identifier bsd 4 clause
0bsd | spdx | spdx license identifier 0bsd
gpl-2.0 | gnu | gnu general public license version 2 june 1991
gpl-3.0 | gnu | gnu general public license version 3 29 june 2007
gpl-1.0 | gnu | gnu general public license version 1 february 1989
gpl-2.0-or-later | gnu | under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0-or-later | gnu | under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0-only | gnu | under the terms of the gnu general public license version 2 as published by the free software foundation
gpl-3.0-only | gnu | under the terms of the gnu general public license version 3 as published by the free software foundation
gpl-3.0 | gnu | (?:work|software|program|text|file|document) is licensed under the gnu general public license version 3
gpl-2.0 | gnu | (?:work|software|program|text|file|document) is licensed under the gnu general public license version 2
gpl | gnu | you should have received a copy of the gnu general public license along with this (?:program|file|software|package)
gpl-2.0-only | spdx | spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later | spdx | spdx license identifier gpl 2 0 or later
gpl-3.0-only | spdx | spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later | spdx | spdx license identifier gpl 3 0 or later
lgpl-2.1 | gnu | gnu lesser general public license version 2 1 february 1999
lgpl-3.0 | gnu | gnu lesser general public license version 3 29 june 2007
lgpl-2.0 | gnu | gnu library general public license version 2 june 1991
lgpl-2.1-or-later | gnu | under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3.0-or-later | gnu | under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl | gnu | you should have received a copy of the gnu lesser general public license along with this (?:program|file|software|library)
lgpl-2.1-only | spdx | spdx license identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later | spdx | spdx license identifier lgpl 2 1 or later
lgpl-3.0-only | spdx | spdx license identifier lgpl 3 0(?: only)?
lgpl-3.0-or-later | spdx | spdx license identifier lgpl 3 0 or later
agpl-3.0 | gnu | gnu affero general public license version 3 19 november 2007
agpl-3.0-or-later | gnu | under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl | gnu | you should have received a copy of the gnu affero general public license along with this (?:program|file|software)
agpl-3.0-only | spdx | spdx license identifier agpl 3 0(?: only)?
agpl-3.0-or-later | spdx | spdx license identifier agpl 3 0 or later
gfdl | gnu | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | mozilla | mozilla public license version 2 0
mpl-2.0 | spdx | spdx license identifier mpl 2 0
mpl-1.1 | spdx | spdx license identifier mpl 1 1
epl-1.0 | eclipse | eclipse public license v 1 0 ~accompanies this distribution
epl-2.0 | eclipse | available under the terms of the eclipse public license (?:v 2 0|2 0|version 2 0)
epl-2.0 | spdx | spdx license identifier epl 2 0
epl-1.0 | spdx | spdx license identifier epl 1 0
cddl-1.0 | cddl | subject to the terms of the common development and distribution license
cddl-1.0 | common development | common development and distribution license cddl version 1 0
cddl-1.1 | spdx | spdx license identifier cddl 1 1
unlicense | unencumbered | this is free and unencumbered software released into the public domain
unlicense | spdx | spdx license identifier unlicense
wtfpl | want to | do what the fuck you want to public license
zlib | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | spdx | spdx license identifier zlib
bsl-1.0 | boost | boost software license version 1 0 august 17th 2003
bsl-1.0 | spdx | spdx license identifier bsl 1 0
cc0-1.0 | creative commons | creative commons cc0 1 0 universal
cc0-1.0 | spdx | spdx license identifier cc0 1 0
cc-by-4.0 | creative commons | licensed under a creative commons attribution 4 0 international license
cc-by-3.0 | creative commons | licensed under a creative commons attribution 3 0 unported license
cc-by-sa-4.0 | creative commons | licensed under a creative commons attribution share ?alike 4 0 international license
cc-by-sa-3.0 | creative commons | licensed under a creative commons attribution share ?alike 3 0 unported license
cc-by-nc-4.0 | creative commons | licensed under a creative commons attribution non ?commercial 4 0 international license
cc-by-nd-4.0 | creative commons | licensed under a creative commons attribution no ?deriv(?:ative)?s 4 0 international license
cc-by-nc-sa-4.0 | creative commons | licensed under a creative commons attribution non ?commercial share ?alike 4 0 international license
cc-by-nc-nd-4.0 | creative commons | licensed under a creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0 international license
artistic-2.0 | artistic | the artistic license 2 0 copyright
artistic-2.0 | spdx | spdx license identifier artistic 2 0
psf-2.0 | python software foundation | python software foundation license version 2
ms-pl | microsoft | microsoft public license ms pl
ms-rl | microsoft | microsoft reciprocal license ms rl
eupl-1.2 | european union | european union public licen[cs]e v 1 2
ofl-1.1 | open font | sil open font license version 1 1
upl-1.0 | universal permissive | universal permissive license v 1 0
openssl | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
proprietary | reserved | all rights reserved ~unauthorized (?:copying|use|reproduction) of this (?:file|software|document) ~is strictly prohibited
proprietary | confidential | this (?:file|software|document) is (?:proprietary and confidential|confidential and proprietary)
"""

#: Names with their versions.
_VERSIONS = """
apache-2.0 | apache | apache licen[cs]e (?:version |v ?)?2(?: 0)?
apache-2.0 | apache | apache (?:version |v ?)?2 0
apache-1.1 | apache | apache (?:software )?license (?:version |v ?)?1 1
apache-1.0 | apache | apache (?:software )?license (?:version |v ?)?1 0
mit | mit license | the mit license
mit | expat | expat license
x11 | x11 license | x11 license
bsd-2-clause | bsd | (?:simplified|2 clause|two clause|freebsd) bsd(?: license)?
bsd-2-clause | bsd | bsd (?:2 clause|two clause)(?: license)?
bsd-3-clause | bsd | (?:new|modified|revised|3 clause|three clause) bsd(?: license)?
bsd-3-clause | bsd | bsd (?:3 clause|three clause)(?: license)?
bsd-4-clause | bsd | (?:original|4 clause|four clause) bsd(?: license)?
bsd-4-clause | bsd | bsd (?:4 clause|four clause)(?: license)?
0bsd | bsd | (?:zero clause bsd|bsd zero clause)(?: license)?
gpl-1.0 | gnu | gnu general public license (?:version |v ?)?1(?: 0)?
gpl-2.0 | gnu | gnu general public license (?:version |v ?)?2(?: 0)?
gpl-3.0 | gnu | gnu general public license (?:version |v ?)?3(?: 0)?
gpl-2.0 | gplv2 | (?:gnu )?gplv2(?: license)?
gpl-3.0 | gplv3 | (?:gnu )?gplv3(?: license)?
gpl-2.0-or-later | gpl | gpl (?:version |v ?)?2(?: 0)? or (?:later|any later version)
gpl-3.0-or-later | gpl | gpl (?:version |v ?)?3(?: 0)? or (?:later|any later version)
gpl-2.0 | gpl | gnu gpl (?:version |v ?)?2(?: 0)?
gpl-3.0 | gpl | gnu gpl (?:version |v ?)?3(?: 0)?
gpl-2.0 | gpl | gpl (?:version |v ?)?2(?: 0)?
gpl-3.0 | gpl | gpl (?:version |v ?)?3(?: 0)?
lgpl-2.0 | gnu | gnu (?:library|lesser) general public license (?:version |v ?)?2(?: 0)?
lgpl-2.1 | gnu | gnu lesser general public license (?:version |v ?)?2 1
lgpl-3.0 | gnu | gnu lesser general public license (?:version |v ?)?3(?: 0)?
lgpl-2.1 | lgpl | lgpl (?:version |v ?)?2 1
lgpl-3.0 | lgpl | lgpl (?:version |v ?)?3(?: 0)?
lgpl-2.0 | lgpl | lgpl (?:version |v ?)?2(?: 0)?
lgpl-3.0 | lgplv3 | (?:gnu )?lgplv3
lgpl-2.1 | lgplv2 | (?:gnu )?lgplv2(?: 1)?
agpl-3.0 | gnu | gnu affero general public license (?:version |v ?)?3(?: 0)?
agpl-3.0 | agpl | agpl (?:version |v ?)?3(?: 0)?
agpl-3.0 | agplv3 | (?:gnu )?agplv3
gfdl-1.3 | gnu | gnu free documentation license (?:version |v ?)?1 3
gfdl-1.2 | gnu | gnu free documentation license (?:version |v ?)?1 2
mpl-1.0 | mozilla | mozilla public license (?:version |v ?)?1 0
mpl-1.1 | mozilla | mozilla public license (?:version |v ?)?1 1
mpl-2.0 | mozilla | mozilla public license (?:version |v ?)?2(?: 0)?
mpl-2.0 | mpl | mpl (?:version |v ?)?2 0
mpl-1.1 | mpl | mpl (?:version |v ?)?1 1
epl-1.0 | eclipse | eclipse public license (?:version |v ?)?1 0
epl-2.0 | eclipse | eclipse public license (?:version |v ?)?2 0
edl-1.0 | eclipse | eclipse distribution license (?:version |v ?)?1 0
cpl-1.0 | common public | common public license (?:version |v ?)?1 0
cddl-1.0 | cddl | cddl (?:version |v ?)?1 0
cddl-1.1 | cddl | cddl (?:version |v ?)?1 1
bsl-1.0 | boost | boost software license (?:version |v ?)?1 0
cc0-1.0 | cc0 | cc0 1 0
cc-by-4.0 | cc by | cc by (?:version |v ?)?4 0
cc-by-3.0 | cc by | cc by (?:version |v ?)?3 0
cc-by-2.5 | cc by | cc by (?:version |v ?)?2 5
cc-by-2.0 | cc by | cc by (?:version |v ?)?2 0
cc-by-1.0 | cc by | cc by (?:version |v ?)?1 0
cc-by-sa-4.0 | cc by | cc by sa (?:version |v ?)?4 0
cc-by-sa-3.0 | cc by | cc by sa (?:version |v ?)?3 0
cc-by-sa-2.5 | cc by | cc by sa (?:version |v ?)?2 5
cc-by-sa-2.0 | cc by | cc by sa (?:version |v ?)?2 0
cc-by-nc-4.0 | cc by | cc by nc (?:version |v ?)?4 0
cc-by-nc-3.0 | cc by | cc by nc (?:version |v ?)?3 0
cc-by-nc-2.0 | cc by | cc by nc (?:version |v ?)?2 0
cc-by-nd-4.0 | cc by | cc by nd (?:version |v ?)?4 0
cc-by-nd-3.0 | cc by | cc by nd (?:version |v ?)?3 0
cc-by-nc-sa-4.0 | cc by | cc by nc sa (?:version |v ?)?4 0
cc-by-nc-sa-3.0 | cc by | cc by nc sa (?:version |v ?)?3 0
cc-by-nc-nd-4.0 | cc by | cc by nc nd (?:version |v ?)?4 0
cc-by-nc-nd-3.0 | cc by | cc by nc nd (?:version |v ?)?3 0
cc-by-4.0 | creative commons | creative commons attribution 4 0(?: international)?
cc-by-3.0 | creative commons | creative commons attribution 3 0(?: unported)?
cc-by-sa-4.0 | creative commons | creative commons attribution share ?alike 4 0(?: international)?
cc-by-sa-3.0 | creative commons | creative commons attribution share ?alike 3 0(?: unported)?
cc-by-nc-4.0 | creative commons | creative commons attribution non ?commercial 4 0(?: international)?
cc-by-nd-4.0 | creative commons | creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?
cc-by-nc-sa-4.0 | creative commons | creative commons attribution non ?commercial share ?alike 4 0(?: international)?
cc-by-nc-nd-4.0 | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?
artistic-1.0 | artistic | artistic license (?:version |v ?)?1 0
artistic-2.0 | artistic | artistic license (?:version |v ?)?2 0
osl-3.0 | open software license | open software license (?:version |v ?)?3 0
osl-2.1 | open software license | open software license (?:version |v ?)?2 1
afl-3.0 | academic free | academic free license (?:version |v ?)?3 0
afl-2.1 | academic free | academic free license (?:version |v ?)?2 1
eupl-1.1 | eupl | eupl (?:version |v ?)?1 1
eupl-1.2 | eupl | eupl (?:version |v ?)?1 2
ofl-1.1 | open font | (?:sil )?open font license (?:version |v ?)?1 1
odbl-1.0 | open database | open database license (?:version |v ?)?1 0
odc-by-1.0 | open data commons | open data commons attribution license (?:version |v ?)?1 0
pddl-1.0 | open data commons | open data commons public domain dedication and license (?:version |v ?)?1 0
ecl-2.0 | educational community | educational community license (?:version |v ?)?2 0
zpl-2.1 | zope | zope public license (?:version |v ?)?2 1
php-3.01 | php license | php license (?:version |v ?)?3 01
python-2.0 | python license | python license (?:version |v ?)?2 0
npl-1.1 | netscape | netscape public license (?:version |v ?)?1 1
qpl-1.0 | q public | q public license (?:version |v ?)?1 0
ipl-1.0 | ibm public | ibm public license (?:version |v ?)?1 0
lppl-1.3c | latex project | latex project public license (?:version |v ?)?1 3c?
sspl-1.0 | server side | server side public license (?:version |v ?)?1(?: 0)?
busl-1.1 | business source | business source license (?:version |v ?)?1 1
elastic-2.0 | elastic | elastic license (?:version |v ?)?2 0
polyform-nc-1.0 | polyform | polyform noncommercial license (?:version |v ?)?1 0(?: 0)?
mulan-psl-2.0 | mulan | mulan permissive software license (?:version |v ?)?2
"""

#: Bare names.
_NAMES = """
apache | apache | apache (?:software )?foundation license
mit | mit licen | mit licence
bsd | bsd | bsd (?:style )?licen[cs]e
gpl | gpl | (?:gnu )?gpl(?: licen[cs]e)?
lgpl | lgpl | (?:gnu )?lgpl(?: licen[cs]e)?
agpl | agpl | (?:gnu )?agpl(?: licen[cs]e)?
lgpl | gnu | gnu (?:lesser|library) general public licen[cs]e
agpl | gnu | gnu affero general public licen[cs]e
gfdl | gnu | gnu free documentation licen[cs]e
gpl | gnu | gnu public licen[cs]e
mpl | mozilla | mozilla public licen[cs]e
epl | eclipse | eclipse public licen[cs]e
cddl | common development | common development and distribution licen[cs]e
cpl | common public | common public licen[cs]e
isc | isc licen | isc licen[cs]e
zlib | zlib | zlib (?:libpng )?licen[cs]e
bsl | boost | boost software licen[cs]e
artistic | artistic | (?:perl )?artistic licen[cs]e
wtfpl | wtfpl | wtfpl
unlicense | unlicense | (?:the )?unlicense
public-domain | public domain | (?:in|into|to|placed in|released into) the public domain
public-domain | public domain | public domain dedication
cc0 | cc0 | cc0(?: licen[cs]e)?
cc-by-sa | cc by | cc by sa
cc-by-nc | cc by | cc by nc
cc-by-nd | cc by | cc by nd
cc-by-nc-sa | cc by | cc by nc sa
cc-by-nc-nd | cc by | cc by nc nd
cc | creative commons | creative commons(?: licen[cs]e)?
odbl | open database | open database licen[cs]e
ofl | open font | open font licen[cs]e
osl | open software license | open software licen[cs]e
afl | academic free | academic free licen[cs]e
eupl | european union | european union public licen[cs]e
psf | python software foundation | python software foundation licen[cs]e
openssl | openssl | openssl licen[cs]e
vim | vim licen | vim licen[cs]e
ruby | ruby licen | ruby licen[cs]e
proprietary | proprietary | proprietary licen[cs]e
commercial | commercial licen | commercial licen[cs]e
"""

#: (label, phrase): the fixed phrases.
BASE = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))


def rules() -> list[dict]:
    """The rules in order, the phrases first: number, base, label, priority (larger decides), keyword, expression."""
    out = [{"base": True, "label": label, "priority": 1, "keyword": phrase, "expression": phrase} for label, phrase in BASE]
    for priority, block in ((3, _NOTICES), (2, _VERSIONS), (1, _NAMES)):
        for line in block.strip().splitlines():
            label, keyword, expression = (x.strip() for x in line.split(" | ", 2))
            out.append({"base": False, "label": label, "priority": priority, "keyword": keyword, "expression": expression.replace("\\\\", "\\").replace("~", "(?:[^ ]+ ){0,12}")})
    return [{"number": i, **x} for i, x in enumerate(out)]
