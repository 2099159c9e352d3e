"""Ordered signature rules of licences and notices: label, weight and regex of each, the more telling ones first.

A rule is matched against words in lower case with single blanks between them, of letters and digits only, so that ``CC-BY 4.0`` reads
``cc by 4 0``; its end is the end of a word. A rule begins with one or two plain words: those are its keyword, and it is tried only where
they stand. Of two rules whose matches lie one within the other, the earlier one counts.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: The most words that a match may have.
REACH = 26

_RULES = r"""
# GNU Affero
agpl-3.0-or-later 0.98 gnu affero general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version
agpl-3.0-or-later 0.97 gnu affero general public licen[cs]e (version |v)?3( 0)? or( any)? later( version)?
agpl-3.0 0.96 gnu affero general public licen[cs]e (version |v)?3( 0)?
agpl 0.9 gnu affero general public licen[cs]e
agpl-3.0-or-later 0.96 affero general public licen[cs]e (version |v)?3( 0)? or( any)? later( version)?
agpl-3.0 0.94 affero general public licen[cs]e (version |v)?3( 0)?
agpl-1.0 0.94 affero general public licen[cs]e (version |v)?1( 0)?
agpl 0.88 affero general public licen[cs]e
agpl-3.0-or-later 0.92 agpl (version |v)?3( 0)? or later
agpl-3.0 0.9 agpl (version |v)?3( 0)?( only)?
agpl-3.0 0.9 agplv3( only)?
agpl-1.0 0.88 agpl (version |v)?1 0
# GNU Lesser and Library
lgpl-2.1-or-later 0.98 gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the licen[cs]e or at your option any later version
lgpl-3.0-or-later 0.98 gnu lesser general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version
lgpl-3.0-or-later 0.97 gnu lesser general public licen[cs]e (version |v)?3( 0)? or( any)? later( version)?
lgpl-2.1-or-later 0.97 gnu lesser general public licen[cs]e (version |v)?2 1 or( any)? later( version)?
lgpl-3.0 0.96 gnu lesser general public licen[cs]e (version |v)?3( 0)?
lgpl-2.1 0.96 gnu lesser general public licen[cs]e (version |v)?2 1
lgpl-2.0-or-later 0.97 gnu library general public licen[cs]e (version |v)?2( 0)? or( any)? later( version)?
lgpl-2.0 0.96 gnu library general public licen[cs]e (version |v)?2( 0)?
lgpl 0.92 gnu library general public licen[cs]e
lgpl 0.92 gnu lesser general public licen[cs]e
lgpl-3.0 0.94 lesser general public licen[cs]e (version |v)?3( 0)?
lgpl-2.1 0.94 lesser general public licen[cs]e (version |v)?2 1
lgpl 0.88 lesser general public licen[cs]e
lgpl-2.0 0.92 library general public licen[cs]e (version |v)?2( 0)?
lgpl 0.86 library general public licen[cs]e
lgpl-3.0-or-later 0.92 lgpl (version |v)?3( 0)? or later
lgpl-2.1-or-later 0.92 lgpl (version |v)?2 1 or later
lgpl-3.0 0.9 lgpl (version |v)?3( 0)?( only)?
lgpl-2.1 0.9 lgpl (version |v)?2 1( only)?
lgpl-2.0 0.9 lgpl (version |v)?2( 0)?( only)?
lgpl-3.0 0.9 lgplv3( only)?
lgpl-2.1 0.9 lgplv2 1( only)?
lgpl-2.0 0.88 lgplv2
# GNU Free Documentation
gfdl-1.3 0.95 gnu free documentation licen[cs]e (version |v)?1 3
gfdl-1.2 0.95 gnu free documentation licen[cs]e (version |v)?1 2
gfdl-1.1 0.95 gnu free documentation licen[cs]e (version |v)?1 1
gfdl 0.92 gnu free documentation licen[cs]e
gfdl-1.3 0.86 gfdl (version |v)?1 3
gfdl-1.2 0.86 gfdl (version |v)?1 2
# GNU General Public, with exceptions first
gpl-2.0-with-classpath-exception 0.96 gnu general public licen[cs]e (version |v)?2( 0)? with( the)? classpath exception
gpl-2.0-with-classpath-exception 0.92 gpl (version |v)?2( 0)? with( the)? classpath exception
gpl-with-gcc-exception 0.92 gcc runtime library exception
gpl-with-font-exception 0.9 gpl font exception
gpl-with-linking-exception 0.88 gpl linking exception
gpl-2.0-or-later 0.98 gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version
gpl-3.0-or-later 0.98 gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version
gpl-3.0-or-later 0.97 gnu general public licen[cs]e (version |v)?3( 0)? or( any)? later( version)?
gpl-2.0-or-later 0.97 gnu general public licen[cs]e (version |v)?2( 0)? or( any)? later( version)?
gpl-1.0-or-later 0.97 gnu general public licen[cs]e (version |v)?1( 0)? or( any)? later( version)?
gpl-3.0 0.96 gnu general public licen[cs]e (version |v)?3( 0)?( only)?
gpl-2.0 0.96 gnu general public licen[cs]e (version |v)?2( 0)?( only)?
gpl-1.0 0.96 gnu general public licen[cs]e (version |v)?1( 0)?( only)?
gpl-3.0 0.95 gnu gpl (version |v)?3( 0)?
gpl-3.0 0.95 gnu gplv3
gpl-2.0 0.95 gnu gpl (version |v)?2( 0)?
gpl-2.0 0.95 gnu gplv2
gpl-any 0.92 gnu general public licen[cs]e
gpl-3.0 0.93 general public licen[cs]e (version |v)?3( 0)?
gpl-2.0 0.93 general public licen[cs]e (version |v)?2( 0)?
gpl-3.0-or-later 0.92 gpl (version |v)?3( 0)? or( any)? later( version)?
gpl-2.0-or-later 0.92 gpl (version |v)?2( 0)? or( any)? later( version)?
gpl-3.0 0.9 gpl (version |v)?3( 0)?( only)?
gpl-2.0 0.9 gpl (version |v)?2( 0)?( only)?
gpl-1.0 0.88 gpl (version |v)?1 0( only)?
gpl-3.0-or-later 0.92 gplv3 or( any)? later( version)?
gpl-2.0-or-later 0.92 gplv2 or( any)? later( version)?
gpl-3.0 0.9 gplv3( only)?
gpl-2.0 0.9 gplv2( only)?
gpl-any 0.6 gnu gpl
# Creative Commons by its short names
cc-by-nc-nd-4.0 0.97 cc by nc nd 4( 0)?
cc-by-nc-nd-3.0 0.97 cc by nc nd 3( 0)?
cc-by-nc-nd-2.5 0.97 cc by nc nd 2 5
cc-by-nc-nd-2.0 0.97 cc by nc nd 2( 0)?
cc-by-nc-sa-4.0 0.97 cc by nc sa 4( 0)?
cc-by-nc-sa-3.0 0.97 cc by nc sa 3( 0)?
cc-by-nc-sa-2.5 0.97 cc by nc sa 2 5
cc-by-nc-sa-2.0 0.97 cc by nc sa 2( 0)?
cc-by-nc-4.0 0.97 cc by nc 4( 0)?
cc-by-nc-3.0 0.97 cc by nc 3( 0)?
cc-by-nc-2.5 0.97 cc by nc 2 5
cc-by-nc-2.0 0.97 cc by nc 2( 0)?
cc-by-nd-4.0 0.97 cc by nd 4( 0)?
cc-by-nd-3.0 0.97 cc by nd 3( 0)?
cc-by-nd-2.0 0.97 cc by nd 2( 0)?
cc-by-sa-4.0 0.97 cc by sa 4( 0)?
cc-by-sa-3.0 0.97 cc by sa 3( 0)?
cc-by-sa-2.5 0.97 cc by sa 2 5
cc-by-sa-2.0 0.97 cc by sa 2( 0)?
cc-by-4.0 0.96 cc by 4( 0)?
cc-by-3.0 0.96 cc by 3( 0)?
cc-by-2.5 0.96 cc by 2 5
cc-by-2.0 0.96 cc by 2( 0)?
cc-by-nc-nd 0.93 cc by nc nd
cc-by-nc-sa 0.93 cc by nc sa
cc-by-nc 0.92 cc by nc
cc-by-nd 0.92 cc by nd
cc-by-sa 0.92 cc by sa
cc0-1.0 0.95 cc0 1 0( universal)?
cc0 0.88 cc0
cc-pdm 0.9 cc pdm
cc-pdm 0.9 public domain mark( 1 0)?
# Creative Commons by its long names and addresses
cc-by-nc-nd-4.0 0.97 creative commons attribution non ?commercial no ?deriv(ative)?(ative work)?s? 4 0( international)?
cc-by-nc-nd 0.93 creative commons attribution non ?commercial no ?deriv(ative)?(ative work)?s?
cc-by-nc-sa-4.0 0.97 creative commons attribution non ?commercial share ?alike 4 0( international)?
cc-by-nc-sa 0.93 creative commons attribution non ?commercial share ?alike
cc-by-nc-4.0 0.97 creative commons attribution non ?commercial 4 0( international)?
cc-by-nc 0.93 creative commons attribution non ?commercial
cc-by-nd 0.93 creative commons attribution no ?deriv(ative)?(ative work)?s?
cc-by-sa-4.0 0.97 creative commons attribution share ?alike 4 0( international)?
cc-by-sa-3.0 0.97 creative commons attribution share ?alike 3 0( unported)?
cc-by-sa 0.93 creative commons attribution share ?alike
cc-by-4.0 0.96 creative commons attribution 4 0( international)?
cc-by-3.0 0.96 creative commons attribution 3 0( unported)?
cc-by-long 0.9 creative commons attribution( licen[cs]e)?
cc0-1.0 0.96 creative commons zero( v?1 0( universal)?)?
cc-zero 0.9 creative commons (cc0|public domain dedication)
cc-any 0.75 creative commons licen[cs]es?
cc-url 0.9 creativecommons org licenses by( nc| nd| sa)*( \d \d)?
cc0-1.0 0.94 creativecommons org publicdomain zero( 1 0)?
cc-pdm 0.92 creativecommons org publicdomain mark( 1 0)?
# Apache
apache-2.0 0.98 licensed under the apache licen[cs]e version 2 0( the license)?
apache-2.0 0.97 apache licen[cs]e( version| v)? 2( 0)?
apache-2.0 0.97 apache software licen[cs]e( version| v)? 2( 0)?
apache-1.1 0.97 apache software licen[cs]e( version| v)? 1 1
apache-1.1 0.96 apache licen[cs]e( version| v)? 1 1
apache-1.0 0.96 apache licen[cs]e( version| v)? 1 0
apache-2.0 0.92 apache 2 0( licen[cs]ed?)?
apache-2.0 0.9 apache2 licen[cs]e
apache-url 0.92 apache org licenses license 2 0
apache-any 0.85 apache licen[cs]e
apache-any 0.85 apache software licen[cs]e
# MIT and its kin
mit 0.97 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit-style 0.85 permission is hereby granted free of charge
mit-0 0.95 mit no attribution
mit-0 0.93 mit 0 licen[cs]e
mit 0.93 released under the mit licen[cs]e
mit 0.93 licensed under the mit licen[cs]e
mit 0.93 distributed under the mit licen[cs]e
mit 0.9 mit licen[cs]ed?
mit 0.88 mit style licen[cs]e
mit 0.9 opensource org licenses mit( license)?
x11 0.9 x11 licen[cs]e
mit-modern 0.85 permission to use copy modify and distribute this software and its documentation for any purpose
isc 0.94 permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc 0.9 isc licen[cs]e
expat 0.88 expat licen[cs]e
json 0.9 the software shall be used for good not evil
hpnd 0.85 historical permission notice and disclaimer
# BSD
bsd-4-clause 0.93 all advertising materials mentioning features or use of this software must display
bsd-3-clause 0.94 neither the name of the copyright holder nor the names of its contributors may be used to endorse
bsd-3-clause 0.88 neither the name of [^ ]+( [^ ]+){0,8} nor the names of its contributors
bsd-any 0.93 redistribution and use in source and binary forms with or without modification are permitted
bsd-4-clause 0.93 bsd (4|four) clause( licen[cs]e)?
bsd-3-clause 0.93 bsd (3|three) clause( licen[cs]e)?
bsd-2-clause 0.93 bsd (2|two) clause( licen[cs]e)?
bsd-0-clause 0.93 bsd (0|zero) clause( licen[cs]e)?
bsd-0-clause 0.92 0bsd licen[cs]e
bsd-3-clause 0.92 new bsd licen[cs]e
bsd-3-clause 0.92 modified bsd licen[cs]e
bsd-3-clause 0.92 revised bsd licen[cs]e
bsd-2-clause 0.92 simplified bsd licen[cs]e
bsd-2-clause 0.92 freebsd licen[cs]e
bsd-4-clause 0.92 original bsd licen[cs]e
bsd-any 0.85 bsd licen[cs]ed?
bsd-any 0.82 bsd style licen[cs]e
bsd-3-clause 0.9 opensource org licenses bsd 3 clause
bsd-2-clause 0.9 opensource org licenses bsd 2 clause
# Mozilla, Eclipse, Sun, Common Public
mpl-2.0 0.97 this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
mpl-2.0 0.96 mozilla public licen[cs]e( version| v)? 2( 0)?
mpl-1.1 0.96 mozilla public licen[cs]e( version| v)? 1 1
mpl-1.0 0.96 mozilla public licen[cs]e( version| v)? 1 0
mpl-any 0.9 mozilla public licen[cs]e
mpl-2.0 0.9 mpl 2( 0)?
mpl-1.1 0.9 mpl 1 1
mpl-2.0 0.9 mozilla org mpl 2 0
epl-2.0 0.96 eclipse public licen[cs]e( version| v)? 2( 0)?
epl-1.0 0.96 eclipse public licen[cs]e( version| v)? 1( 0)?
epl-any 0.9 eclipse public licen[cs]e
epl-2.0 0.88 epl 2 0
epl-1.0 0.88 epl 1 0
edl-1.0 0.9 eclipse distribution licen[cs]e( version| v)?( 1 0)?
cddl-1.1 0.95 common development and distribution licen[cs]e( cddl)?( version| v)? 1 1
cddl-1.0 0.95 common development and distribution licen[cs]e( cddl)?( version| v)? 1( 0)?
cddl-any 0.9 common development and distribution licen[cs]e
cpl-1.0 0.9 common public licen[cs]e( version| v)?( 1 0)?
cpal-1.0 0.9 common public attribution licen[cs]e
ipl-1.0 0.9 ibm public licen[cs]e
spl-1.0 0.9 sun public licen[cs]e
npl 0.88 netscape public licen[cs]e
apsl-2.0 0.92 apple public source licen[cs]e( version| v)?( 2( 0)?)?
qpl-1.0 0.85 q public licen[cs]e
# Europe and governments
eupl-1.2 0.95 european union public licen[cs]e( eupl)?( version| v)? ?1 2
eupl-1.1 0.95 european union public licen[cs]e( eupl)?( version| v)? ?1 1
eupl-any 0.9 european union public licen[cs]e
eupl-1.2 0.88 eupl (v ?)?1 2
cecill-2.1 0.92 cecill( free software licen[cs]e agreement)?( version| v)? ?2 1
cecill-b 0.9 cecill b
cecill-c 0.9 cecill c
cecill-any 0.8 cecill
ogl-3.0 0.93 open government licen[cs]e( version| v)? ?3( 0)?
ogl-any 0.88 open government licen[cs]e
etalab-2.0 0.9 licence ouverte( open licence)?( version)?( 2 0)?
dl-de-by-2.0 0.9 datenlizenz deutschland namensnennung( version)?( 2 0)?
dl-de-zero-2.0 0.9 datenlizenz deutschland zero( version)?( 2 0)?
usgov-pd 0.85 work of the united states government
# Data
odbl-1.0 0.94 open database licen[cs]e( odbl)?( v?1 0)?
odbl-1.0 0.86 odbl( v?1 0)?
odc-by-1.0 0.92 open data commons attribution licen[cs]e
pddl-1.0 0.92 open data commons public domain dedication and licen[cs]e
cdla-permissive 0.92 community data licen[cs]e agreement permissive( version)?( \d \d)?
cdla-sharing 0.92 community data licen[cs]e agreement sharing( version)?( \d \d)?
openrail 0.88 openrail( m| \+\+ m)?( licen[cs]e)?
# Fonts, documents, hardware
ofl-1.1 0.95 sil open font licen[cs]e( version| v)?( 1 1)?
ofl-1.1 0.86 open font licen[cs]e
ufl-1.0 0.9 ubuntu font licen[cs]e
lppl-1.3 0.94 latex project public licen[cs]e( version| v)?( 1 3[abc]?)?
gust-font 0.88 gust font licen[cs]e
cern-ohl 0.92 cern open hardware licen[cs]e( version)?( \d( \d)?)?
solderpad 0.88 solderpad hardware licen[cs]e
# Permissive, by name
unlicense 0.94 this is free and unencumbered software released into the public domain
unlicense 0.88 the unlicense
zlib 0.93 zlib libpng licen[cs]e
zlib 0.9 zlib licen[cs]e
zlib 0.9 this software is provided as is without any express or implied warranty in no event will the authors be held liable
libpng 0.88 libpng licen[cs]e
boost-1.0 0.94 boost software licen[cs]e( version| v)?( 1 0)?
wtfpl 0.9 do what the fuck you want to public licen[cs]e
wtfpl 0.85 wtfpl
artistic-2.0 0.93 artistic licen[cs]e( version| v)? 2( 0)?
artistic-1.0 0.93 artistic licen[cs]e( version| v)? 1( 0)?
artistic-any 0.85 artistic licen[cs]e
perl 0.85 under the same terms as perl itself
psf-2.0 0.93 python software foundation licen[cs]e( version| v)?( 2)?
ruby 0.85 ruby licen[cs]e
php-3.01 0.93 php licen[cs]e( version| v)? 3 0?1
php-any 0.85 php licen[cs]e
openssl 0.9 openssl licen[cs]e
ncsa 0.9 university of illinois( ncsa)? open source licen[cs]e
ntp 0.85 ntp licen[cs]e
postgresql 0.9 postgresql licen[cs]e
upl-1.0 0.92 universal permissive licen[cs]e( version| v)?( 1 0)?
ecl-2.0 0.92 educational community licen[cs]e( version| v)?( 2 0)?
afl-3.0 0.92 academic free licen[cs]e( version| v)?( 3 0)?
osl-3.0 0.92 open software licen[cs]e( version| v)?( 3 0)?
ms-pl 0.92 microsoft public licen[cs]e
ms-rl 0.92 microsoft reciprocal licen[cs]e
mulan-psl-2.0 0.92 mulan permissive software licen[cs]e( version| v)?( 2)?
blueoak-1.0.0 0.92 blue oak model licen[cs]e( 1 0 0)?
beerware 0.88 beer ware licen[cs]e
sleepycat 0.88 sleepycat licen[cs]e
w3c 0.9 w3c software( notice)? and( document)? licen[cs]e
unicode 0.88 unicode licen[cs]e( agreement)?( v3)?
icu 0.85 icu licen[cs]e
curl 0.85 curl licen[cs]e
freetype 0.88 freetype project licen[cs]e
ijg 0.88 independent jpeg group
vim 0.85 vim licen[cs]e
tcl 0.85 tcl tk licen[cs]e
zope-2.1 0.9 zope public licen[cs]e( version)?( 2 1)?
rpl-1.5 0.9 reciprocal public licen[cs]e( version)?( 1 5)?
# Source available
busl-1.1 0.94 business source licen[cs]e( version| v)?( 1 1)?
sspl-1.0 0.94 server side public licen[cs]e( version| v)?( 1)?
elastic-2.0 0.93 elastic licen[cs]e( version| v)?( 2( 0)?)?
commons-clause 0.92 commons clause( licen[cs]e condition)?( v?1 0)?
polyform-noncommercial 0.92 polyform noncommercial( licen[cs]e)?( 1 0 0)?
polyform-small-business 0.92 polyform small business( licen[cs]e)?( 1 0 0)?
fsl 0.9 functional source licen[cs]e
# SPDX tags
apache-2.0 0.99 spdx license identifier apache 2 0
mit 0.99 spdx license identifier mit
bsd-3-clause 0.99 spdx license identifier bsd 3 clause
bsd-2-clause 0.99 spdx license identifier bsd 2 clause
gpl-2.0 0.99 spdx license identifier gpl 2 0( only)?
gpl-3.0 0.99 spdx license identifier gpl 3 0( only)?
lgpl-2.1 0.99 spdx license identifier lgpl 2 1( only)?
lgpl-3.0 0.99 spdx license identifier lgpl 3 0( only)?
agpl-3.0 0.99 spdx license identifier agpl 3 0( only)?
mpl-2.0 0.99 spdx license identifier mpl 2 0
isc 0.99 spdx license identifier isc
cc0-1.0 0.99 spdx license identifier cc0 1 0
spdx-tag 0.9 spdx license identifier [^ ]+
# Notices in four languages
some-rights 0.7 some rights reserved
reserved 0.6 all rights reserved
reserved-de 0.6 alle rechte vorbehalten
reserved-fr 0.6 tous droits réservés
reserved-es 0.6 todos los derechos reservados
copyright-notice 0.5 copyright( c| ©)? (19|20)\d\d( (19|20)\d\d)*
copyright-notice 0.4 copyright by [^ ]+
public-domain 0.7 released into the public domain
public-domain 0.7 dedicated to the public domain
public-domain 0.5 in the public domain
public-domain 0.6 domaine public
public-domain 0.6 dominio público
public-domain 0.6 gemeinfrei
public-domain 0.6 gemeinfreie
proprietary 0.8 proprietary and confidential
proprietary 0.8 confidential and proprietary
proprietary 0.75 unauthorized copying of this (file|document|software|work)
proprietary 0.7 no part of this (publication|book|document|work) may be reproduced
internal 0.6 for internal use only
no-redistribution 0.6 not for (re)?distribution
noncommercial 0.6 for noncommercial use only
noncommercial 0.6 for non commercial use only
noncommercial 0.6 for personal use only
noncommercial 0.6 nur für den (privaten|persönlichen) gebrauch
noncommercial 0.6 usage strictement personnel
gpl-any 0.85 gnu allgemeine (öffentliche )?lizenz
mit 0.85 unter der mit lizenz
mit 0.85 sous licence mit
mit 0.85 bajo la licencia mit
apache-any 0.85 apache lizenz
cc-any 0.7 creative commons lizenz
cc-any 0.7 licence creative commons
cc-any 0.7 licencia creative commons
# The three phrases of the contract, which count wherever they stand
cc-by 0.9 cc by
gpl 0.85 general public license
gpl-any 0.5 gpl
"""

#: The phrases that the contract counts, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


class Rule(NamedTuple):
    rank: int
    label: str
    weight: float
    base: bool
    keyword: str
    pattern: str


def _keyword(pattern: str) -> str:
    """The whole plain words that a pattern begins with, two at most; a group after a word begins with a blank or is not part of it."""
    plain = re.match(r"[^\\()\[\]{}?*+|.]*", pattern)[0]
    rest = pattern[len(plain) :]
    whole = plain.split() if not rest or plain.endswith(" ") or rest.startswith("( ") else plain.split()[:-1]
    if not whole:
        raise ValueError(f"a rule begins with a plain word: {pattern}")
    return " ".join(whole[:2])


def rules() -> list[Rule]:
    """All rules in their order; patterns end with the blank after their last word."""
    lines = [x.split(" ", 2) for x in _RULES.strip().splitlines() if not x.startswith("#")]
    return [Rule(k, label, float(weight), BASE.get(p) == label, _keyword(p), f"^(?:{p}) ") for k, (label, weight, p) in enumerate(lines)]
