"""Signature rules for licenses: hand-written expressions over the words of a text.

Rules see lower-cased words with one space between them, so "CC-BY 4.0" reads `cc by 4 0`. A rule has a label, a tier (its
priority), a weight and gate words: one of them must occur in the text before the expression is tried. Families with several versions
are written once, with the version as a parameter.
"""

from __future__ import annotations

from typing import NamedTuple

BASE, GENERIC, PHRASE, NAME, EXACT, TAG = range(6)
WEIGHTS = (0.5, 0.3, 0.7, 0.8, 0.95, 1.0)


class Rule(NamedTuple):
    name: str
    label: str
    tier: int
    gate: tuple[str, ...]
    pattern: str


#: Phrases that are always reported, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

GRANT = r"(?:(?:re)?(?:licen[sc]ed|distributed|released|published|provided|available)(?: to you)? under (?:the )?(?:terms (?:of|and conditions of) (?:the )?)?(?:an? )?)"
GNU = ("gpl", "lgpl", "agpl", "gfdl")
LATER = r"(?: (?:of the license )?(?:or (?:at your option )?any later version|or (?:any )?(?:later|newer)(?: versions?)?|and later)|\+)"
VERSION = r" (?:v ?|version |ver )?"

#: One name each. label | gate words | title | identifier | address (- for none).
NAMED = r"""
mit | mit expat | (?:the )?(?:mit|expat)(?: x11)? licen[sc]e | mit | opensource org licen[sc]es? mit
mit-0 | mit | mit no attribution(?: licen[sc]e)? | mit 0 | opensource org licen[sc]es? mit 0
x11 | x11 | x11 (?:style )?licen[sc]e | x11 | -
isc | isc | isc licen[sc]e | isc | opensource org licen[sc]es? isc
0bsd | 0bsd clause | (?:bsd zero|zero|0) clause bsd(?: licen[sc]e)? | 0bsd | opensource org licen[sc]es? 0bsd
bsd-1-clause | clause | (?:bsd )?(?:1|one) clause(?: bsd)?(?: licen[sc]e)? | bsd 1 clause | -
bsd-2-clause | bsd freebsd | (?:simplified|freebsd|(?:2|two) clause) bsd(?: licen[sc]e)?|bsd (?:2|two) clause(?: licen[sc]e)? | bsd 2 clause | opensource org licen[sc]es? bsd 2 clause
bsd-3-clause | bsd | (?:new|revised|modified|(?:3|three) clause) bsd(?: licen[sc]e)?|bsd (?:3|three) clause(?: licen[sc]e)? | bsd 3 clause | opensource org licen[sc]es? bsd 3 clause
bsd-4-clause | bsd | (?:original|old|(?:4|four) clause) bsd(?: licen[sc]e)?|bsd (?:4|four) clause(?: licen[sc]e)? | bsd 4 clause | -
bsd | bsd | bsd (?:style )?licen[sc]e | bsd | -
zlib | zlib | zlib(?: libpng)? licen[sc]e | zlib | opensource org licen[sc]es? zlib
libpng | libpng | libpng licen[sc]e | libpng(?: 2 0)? | -
bsl-1.0 | boost | boost software licen[sc]e | bsl 1 0 | boost org license 1 0
unlicense | unlicense | (?:the )?unlicense | unlicense | unlicense org
wtfpl | wtfpl fuck | wtfpl|do what the fuck you want to public licen[sc]e | wtfpl | wtfpl net
beerware | beerware beer | beer ?ware(?: licen[sc]e)? | beerware | -
postgresql | postgresql | postgresql licen[sc]e | postgresql | opensource org licen[sc]es? postgresql
openssl | openssl | openssl(?: and ssleay)? licen[sc]e | openssl | openssl org source license
curl | curl | curl licen[sc]e | curl | curl se docs copyright
ijg | ijg jpeg | independent jpeg group licen[sc]e|ijg licen[sc]e | ijg | -
ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? licen[sc]e | ncsa | opensource org licen[sc]es? ncsa
w3c | w3c | w3c software (?:notice and )?(?:document )?licen[sc]e | w3c | w3 org consortium legal
ruby | ruby | ruby licen[sc]e | ruby | ruby lang org en about license
perl | perl | same terms as perl(?: (?:5|itself))? | - | dev perl org licenses
vim | vim | vim licen[sc]e | vim | -
tcl | tcl | tcl tk licen[sc]e|tcl licen[sc]e | tcl | -
sleepycat | sleepycat | sleepycat licen[sc]e | sleepycat | opensource org licen[sc]es? sleepycat
intel | intel | intel open source licen[sc]e | intel | -
naumen | naumen | naumen public licen[sc]e | naumen | -
fair | fair | fair licen[sc]e | fair | opensource org licen[sc]es? fair
hpnd | hpnd historical | historical permission notice and disclaimer | hpnd | -
upl-1.0 | upl universal | universal permissive licen[sc]e | upl 1 0 | opensource org licen[sc]es? upl
ms-pl | microsoft ms | microsoft public licen[sc]e | ms pl | opensource org licen[sc]es? ms pl
ms-rl | microsoft ms | microsoft reciprocal licen[sc]e | ms rl | opensource org licen[sc]es? ms rl
ibm-ipl-1.0 | ibm ipl | ibm public licen[sc]e | ipl 1 0 | -
cpl-1.0 | cpl common | common public licen[sc]e(?: version 1 0)? | cpl 1 0 | -
cpal-1.0 | cpal attribution | common public attribution licen[sc]e | cpal 1 0 | -
rpl-1.5 | rpl reciprocal | reciprocal public licen[sc]e | rpl 1 5 | -
sissl | sissl sun | sun industry standards source licen[sc]e | sissl | -
qpl-1.0 | qpl q | q public licen[sc]e | qpl 1 0 | -
pddl-1.0 | pddl | (?:odc )?public domain dedication and licen[sc]e|pddl | pddl 1 0 | opendatacommons org licenses pddl
odbl-1.0 | odbl database | open database licen[sc]e|odbl | odbl 1 0 | opendatacommons org licenses odbl
odc-by-1.0 | odc opendatacommons attribution | open data commons attribution licen[sc]e | odc by 1 0 | opendatacommons org licenses by
ofl-1.1 | ofl sil | (?:sil )?open font licen[sc]e | ofl 1 1 | scripts sil org ofl
sspl-1.0 | sspl server | server side public licen[sc]e | sspl 1 0 | mongodb com licensing server side public license
busl-1.1 | busl business | business source licen[sc]e | busl 1 1 | mariadb com bsl11
elastic-2.0 | elastic | elastic licen[sc]e(?: 2 0| v2)? | elastic 2 0 | elastic co licensing elastic license
commons-clause | clause | commons clause(?: licen[sc]e)? condition|commons clause | - | commonsclause com
confluent-1.0 | confluent | confluent community licen[sc]e | - | confluent io confluent community license
mulanpsl-2.0 | mulan mulanpsl | mulan psl v2|mulan permissive software licen[sc]e | mulanpsl 2 0 | license coscl org cn mulanpsl2
blueoak-1.0.0 | blue blueoak | blue oak model licen[sc]e | blueoak 1 0 0 | blueoakcouncil org license
hippocratic | hippocratic | hippocratic licen[sc]e | hippocratic 2 1 | firstdonoharm dev
polyform-nc-1.0.0 | polyform | polyform noncommercial licen[sc]e | polyform noncommercial 1 0 0 | polyformproject org licenses noncommercial
openrail | openrail rail | (?:creativeml |bigscience |bigcode )?open ?rail(?: m)?(?: licen[sc]e)? | openrail | huggingface co spaces bigscience license
json | json evil | json licen[sc]e | json | json org license
jasper-2.0 | jasper | jasper licen[sc]e | jasper 2 0 | -
info-zip | zip | info zip licen[sc]e | info zip | -
imagemagick | imagemagick | imagemagick licen[sc]e | imagemagick | imagemagick org script license
freetype | freetype ftl | freetype (?:project )?licen[sc]e | ftl | -
unicode | unicode | unicode (?:inc )?(?:licen[sc]e agreement|terms of use)|unicode licen[sc]e v3 | unicode 3 0 | unicode org copyright
icu | icu | icu licen[sc]e | icu | -
netcdf | netcdf | netcdf licen[sc]e | netcdf | -
bzip2 | bzip2 | bzip2 licen[sc]e | bzip2 1 0 6 | -
linux-man-pages | verbatim | linux man pages copyleft | linux man pages copyleft | -
ogc-1.0 | ogc | ogc software licen[sc]e | ogc 1 0 | -
nasa-1.3 | nasa | nasa open source agreement | nasa 1 3 | opensource org licen[sc]es? nasa 1 3
etalab-2.0 | etalab ouverte | licence ouverte|etalab open licen[sc]e | etalab 2 0 | -
dl-de-by-2.0 | datenlizenz dl | datenlizenz deutschland namensnennung | dl de by 2 0 | govdata de dl de by
cdla-permissive-2.0 | cdla community | community data licen[sc]e agreement permissive | cdla permissive 2 0 | cdla dev permissive
cdla-sharing-1.0 | cdla community | community data licen[sc]e agreement sharing | cdla sharing 1 0 | cdla dev sharing
gfdl-invariants | invariant | with no invariant sections | - | -
cc0-1.0 | cc0 cc zero | cc0|creative commons zero|cc zero | cc0 1 0 | creativecommons org publicdomain zero
cc-pdm | mark | public domain mark | - | creativecommons org publicdomain mark
cc-by | creative | creative commons attribution(?: licen[sc]e)? | - | creativecommons org licenses by
cc | creative | creative commons(?: licen[sc]e)? | - | -
gpl | gpl gnu | (?:the )?gnu (?:gpl|general public licen[sc]e)|gpl licen[sc]e | gpl | gnu org licenses gpl
lgpl | lgpl lesser library | (?:gnu )?(?:lgpl|(?:lesser|library) general public licen[sc]e) | lgpl | gnu org licenses lgpl
agpl | agpl affero | (?:gnu )?(?:agpl|affero general public licen[sc]e) | agpl | gnu org licenses agpl
gfdl | gfdl documentation | (?:gnu )?free documentation licen[sc]e|gfdl | gfdl | gnu org licenses fdl
apache | apache | apache (?:software )?licen[sc]e | apache | apache org licenses
mpl | mpl mozilla | mozilla public licen[sc]e | mpl | mozilla org mpl
epl | epl eclipse | eclipse public licen[sc]e | epl | eclipse org legal epl
cddl | cddl development | common development and distribution licen[sc]e | cddl | -
eupl | eupl european | european union public licen[sc]e | eupl | -
artistic | artistic | artistic licen[sc]e | artistic | -
osl | osl | open software licen[sc]e | osl | -
afl | afl academic | academic free licen[sc]e | afl | -
"""

#: Families with versions. label | gate words | name | short names | versions.
VERSIONED = r"""
gpl | gpl gplv1 gplv2 gplv3 gnu general | (?:gnu )?general public | gpl | 1 1.0 2 2.0 3 3.0
lgpl | lgpl lgplv2 lgplv3 lesser library | (?:gnu )?(?:lesser|library) general public | lgpl | 2 2.0 2.1 3 3.0
agpl | agpl agplv1 agplv3 affero | (?:gnu )?affero general public | agpl | 1 1.0 3 3.0
gfdl | gfdl gfdlv1 documentation | (?:gnu )?free documentation | gfdl|fdl | 1.1 1.2 1.3
apache | apache apache2 asl | apache(?: software)? | apache|asl | 1.0 1.1 2 2.0
mpl | mpl mplv2 mozilla | mozilla public | mpl | 1.0 1.1 2 2.0
epl | epl eclipse | eclipse public | epl | 1.0 2.0
cddl | cddl development | common development and distribution | cddl | 1.0 1.1
eupl | eupl european | european union public | eupl | 1.0 1.1 1.2
artistic | artistic | artistic | artistic | 1.0 2.0
osl | osl open | open software | osl | 1.0 1.1 2.0 2.1 3.0
afl | afl academic | academic free | afl | 1.1 1.2 2.0 2.1 3.0
apsl | apsl apple | apple public source | apsl | 1.0 1.1 1.2 2.0
cecill | cecill | cecill(?: free software)? | cecill | 1.0 1.1 2.0 2.1
lppl | lppl latex | latex project public | lppl | 1.0 1.1 1.2 1.3a 1.3c
php | php | php | php | 3.0 3.01
psf | psf python | python(?: software foundation)? | psf | 2 2.0
zpl | zpl zope | zope public | zpl | 1.1 2.0 2.1
npl | npl netscape | netscape public | npl | 1.0 1.1
spl | spl sun | sun public | spl | 1.0
ogl-uk | ogl government | (?:uk )?open government | ogl|ogl uk | 1.0 2.0 3.0
openldap | openldap oldap | openldap public | oldap | 2.7 2.8
ecl | ecl educational | educational community | ecl | 1.0 2.0
oclc | oclc | oclc research public | oclc | 2.0
nposl | nposl profit | non profit open software | nposl | 3.0
cern-ohl | cern ohl | cern open hardware | cern ohl | 1.1 1.2 2.0
"""

#: Terms of the Creative Commons licenses, short and long, and their versions.
COMMONS = {
    "by": "attribution",
    "by-sa": "attribution share ?alike",
    "by-nc": "attribution non ?commercial",
    "by-nd": "attribution no ?deriv(?:ative)?s?(?: works)?",
    "by-nc-sa": "attribution non ?commercial share ?alike",
    "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?",
}
COMMONS_VERSIONS = "1.0 2.0 2.5 3.0 4.0".split()

#: Sentences of license texts and notices. label | tier | gate words | expression.
SENTENCES = r"""
mit | 2 | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 2 | substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions
isc | 2 | fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd | 2 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | 2 | endorse | neither the name of(?: [^ ]+){1,12} nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | 2 | advertising | all advertising materials mentioning features or use of this software must display
apache-2.0 | 2 | compliance | you may not use this file except in compliance with the license
apache-2.0 | 2 | perpetual | perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
gpl | 2 | redistribute | this program is free software you can redistribute it and or modify it under the terms of
gpl | 2 | merchantability | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
lgpl | 2 | library | this library is free software you can redistribute it and or modify it
mpl-2.0 | 2 | mozilla mpl | this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0
mpl-1.1 | 2 | mozilla mpl | the contents of this file are subject to the mozilla public license version 1 1
zlib | 2 | misrepresented | the origin of this software must not be misrepresented
bsl-1.0 | 2 | executor obtaining | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
unlicense | 2 | unencumbered | this is free and unencumbered software released into the public domain
beerware | 2 | beer | you can buy me a beer in return
json | 2 | evil | the software shall be used for good not evil
wtfpl | 2 | wtfpl fuck | you just do what the fuck you want to
public-domain | 2 | domain | (?:released|placed|dedicated|is|are)(?: hereby)? (?:in|into|to) the public domain
public-domain | 1 | domain | public domain
gpl | 1 | gpl | gpl
cc-by-sa | 2 | alike | you must distribute your contributions under the same license as the original
cc-by-nc | 2 | commercial | you may not use the material for commercial purposes
cc-by-nd | 2 | remix | if you remix transform or build upon the material you may not distribute the modified material
ofl-1.1 | 2 | font | this font software is licensed under the sil open font license
w3c | 2 | w3c | by obtaining using and or copying this work you (?:the licensee )?agree that you have read
ncsa | 2 | illinois | neither the names of(?: [^ ]+){1,12} university of illinois
epl | 2 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license
cddl | 2 | development | the contents of this file are subject to the terms of the common development and distribution license
proprietary | 2 | proprietary | proprietary and confidential
proprietary | 2 | unauthorized | unauthorized (?:copying|use|reproduction|distribution) of this (?:file|work|document|software)
proprietary | 2 | permission | may not be (?:copied|reproduced|redistributed|republished)(?: [^ ]+){0,8} without (?:the )?(?:prior |express |written )*permission
proprietary | 2 | eula agreement | end user licen[sc]e agreement
noncommercial | 1 | commercial noncommercial | (?:for )?non ?commercial (?:use|purposes) only
noncommercial | 1 | commercial | not for commercial use
no-derivatives | 1 | derivative | no derivative works(?: permitted)?
copyright | 1 | copyright | copyright (?:c )?(?:19|20)[0-9]{2}
copyright | 1 | copyrighted | copyrighted material
permission | 1 | permission | (?:used|reprinted|reproduced) (?:by|with) permission
dual-license | 1 | dual | dual licen[sc]ed
license-notice | 1 | license licence licensed | (?:see|refer to) (?:the )?(?:accompanying )?(?:file )?licen[sc]e(?: file)?(?: for)?(?: details)?
license-notice | 1 | licensed licenced released distributed | (?:licen[sc]ed|released|distributed) under (?:the|an?) (?:[^ ]+ ){1,6}licen[sc]e
"""


def rows(text: str) -> list[list[str]]:
    return [[cell.strip() for cell in line.split(" | ")] for line in text.strip().splitlines()]


def version_pattern(version: str) -> str:
    return version.replace(".", " ")


def long_label(family: str, version: str) -> str:
    return f"{family}-{version}" if "." in version else f"{family}-{version}.0"


def rules() -> list[Rule]:
    """All rules; of two of a tier that find the same words the earlier one wins."""
    made: list[Rule] = [Rule(f"base {phrase}", label, BASE, (phrase.split()[-1],), phrase) for phrase, label in PHRASES.items()]

    def add(form: str, label: str, tier: int, gate, pattern: str) -> None:
        made.append(Rule(f"{label} {form}", label, tier, tuple(gate), pattern))

    for label, gate, name, short, versions in rows(VERSIONED):
        gate = gate.split()
        for version in versions.split():
            digits, exact = version_pattern(version), long_label(label, version)
            # "2" must not take the first half of "2 1"
            end = "" if "." in version else "(?! [0-9](?: |[a-z]))"
            forms = {
                "title": rf"{name}(?: licen[sc]e)?{VERSION}{digits}{end}",
                "published": rf"{name} licen[sc]e as published by(?: [^ ]+){{1,8}}? version {digits}{end}",
                "short": rf"(?:{short})(?: licen[sc]e)?{VERSION}{digits}{end}",
            }
            for form, pattern in forms.items():
                add(f"{form} {version}", exact, EXACT, gate, f"{GRANT}?(?:the )?(?:{pattern})")
                if label in GNU:
                    add(f"{form} {version} or later", f"{exact}-or-later", EXACT, gate, f"{GRANT}?(?:the )?(?:{pattern}){LATER}")
            add(f"tag {version}", exact, TAG, ("spdx",), rf"spdx license identifier (?:{short}) {digits}(?: only)?{end}")
            if label in GNU:
                add(f"tag {version} or later", f"{exact}-or-later", TAG, ("spdx",), rf"spdx license identifier (?:{short}) {digits} or later")
            if "." in version:
                add(f"address {version}", exact, EXACT, ("licenses", "license", "licences", "licence"), rf"(?:https? )?(?:www )?(?:[a-z]+ org licen[sc]es? (?:{short}) {digits}|{label} org licen[sc]es? license {digits})(?: html| txt)?")
        tight = "|".join(s for s in short.split("|") if " " not in s)
        for version in versions.split():
            if "." not in version and tight:
                add(f"tight {version}", long_label(label, version), EXACT, (*[f"{s}v{version}" for s in tight.split("|")], *[f"{s}{version}" for s in tight.split("|")]), rf"{GRANT}?(?:the )?(?:gnu )?(?:{tight})v?{version}{end}")
    for terms, long in COMMONS.items():
        short = terms.replace("-", " ")
        for version in COMMONS_VERSIONS:
            digits, label = version_pattern(version), f"cc-{terms}-{version}"
            place = "(?: international| unported| generic| [a-z]{2})?"
            add("short", label, EXACT, ("cc",), rf"{GRANT}?(?:the )?cc {short}(?: licen[sc]e)?{VERSION}{digits}{place}")
            add("long", label, EXACT, ("creative",), rf"{GRANT}?(?:the )?creative commons {long}(?: licen[sc]e)?(?: version)? {digits}{place}(?: licen[sc]e)?")
            add("address", label, EXACT, ("creativecommons",), rf"(?:https? )?(?:www )?creativecommons org licenses {short} {digits}")
            add("tag", label, TAG, ("spdx",), rf"spdx license identifier cc {short} {digits}")
        if terms != "by":
            add("short", f"cc-{terms}", NAME, ("cc",), rf"{GRANT}?(?:the )?cc {short}(?: licen[sc]e)?")
            add("long", f"cc-{terms}", NAME, ("creative",), rf"{GRANT}?(?:the )?creative commons {long}(?: licen[sc]e)?")
    for label, gate, title, tag, address in rows(NAMED):
        gate = gate.split()
        add("name", label, NAME, gate, f"(?:{title})")
        add("grant", label, NAME, gate, f"{GRANT}(?:{title})")
        if tag != "-":
            add("tag", label, TAG, ("spdx",), f"spdx license identifier (?:{tag})")
        if address != "-":
            add("address", label, NAME, address.split()[:1], f"(?:https? )?(?:www )?(?:{address})")
    for label, tier, gate, pattern in rows(SENTENCES):
        add("sentence", label, int(tier), gate.split(), pattern)
    return made
