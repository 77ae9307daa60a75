"""License detection by ordered signature rules, in DataFrame and SQL functions only.

Texts become words; a rule is a regular expression over them, tried only where all its
keywords occur. The order of the rules is their priority. A detection inside another is
suppressed, of equal ones the later rule's; the rest is gone through in order of priority,
and one stays if it overlaps none that stays already.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import words

#: Fixed by contract: phrases found wherever their words stand consecutively, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_V = r"(?: v(?:ersion)?)?"
#: Between a name and its number where they are not one word.
_GAP = r"(?: v(?:ersion)? ?| )"
_OR = r"(?: only| or later| or any later version| and later)?"

#: Hand-written signatures over lower-cased words: (label, keywords that every match of every expression holds, expressions).
SIGNATURES = [
    ("gpl-1.0", ["gnu"], [rf"gnu (?:general public license|gpl){_V} 1(?: 0)?{_OR}"]),
    ("gpl-1.0", ["gpl"], [rf"gpl{_GAP}1 0{_OR}"]),
    ("gpl-1.0", ["gpl1"], [rf"gpl1 0{_OR}"]),
    ("gpl-2.0", ["gnu"], [rf"gnu (?:general public license|gpl){_V} ?2(?: 0)?{_OR}", r"gnu general public license as published by the free software foundation version 2"]),
    ("gpl-3.0", ["gnu"], [rf"gnu (?:general public license|gpl){_V} ?3(?: 0)?{_OR}", r"gnu general public license as published by the free software foundation(?: either)? version 3"]),
    ("gpl", ["gnu"], [r"gnu gpl", r"gnu general public licen[cs]e", r"gnu public license", r"gnu org licenses(?: gpl(?: \d(?: \d)?)?)?"]),
    ("gpl-2.0", ["gplv2"], [r"gplv2(?: 0)?(?: only| or later)?"]),
    ("gpl-3.0", ["gplv3"], [r"gplv3(?: 0)?(?: only| or later)?"]),
    ("gpl", ["gpl"], [r"(?:the )?gpl license", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?gpl", r"dual (?:mit gpl|gpl mit)"]),
    ("lgpl-2.1", ["lesser"], [rf"gnu lesser general public license{_V} ?2 1{_OR}"]),
    ("lgpl-3.0", ["lesser"], [rf"gnu lesser general public license{_V} ?3(?: 0)?{_OR}"]),
    ("lgpl", ["lesser"], [r"(?:gnu )?lesser general public license"]),
    ("lgpl-2.0", ["library"], [rf"gnu library general public license(?:{_V} ?2(?: 0)?)?{_OR}"]),
    ("lgpl", ["lgpl"], [r"gnu lgpl", r"lgpl license", rf"lgpl{_GAP}[23](?: [01])?{_OR}"]),
    ("lgpl", ["lgpl2"], [rf"lgpl2(?: [01])?{_OR}"]),
    ("lgpl", ["lgpl3"], [rf"lgpl3(?: [01])?{_OR}"]),
    ("agpl-3.0", ["affero"], [rf"gnu affero general public license(?:{_V} ?3(?: 0)?)?{_OR}", r"affero general public license"]),
    ("agpl-3.0", ["agpl"], [r"gnu agpl", r"agpl license", rf"agpl{_GAP}3(?: 0)?{_OR}"]),
    ("agpl-3.0", ["agpl3"], [rf"agpl3(?: 0)?{_OR}"]),
    ("gfdl", ["documentation"], [rf"gnu free documentation license(?:{_V} 1 [123])?{_OR}"]),
    ("gpl-classpath", ["classpath"], [r"gnu classpath exception", r"classpath exception to the gpl"]),
    ("apache-1.1", ["apache"], [rf"apache (?:software )?license{_V} 1 1"]),
    ("apache-2.0", ["apache"], [rf"apache (?:software )?licen[cs]e{_V} ?2(?: 0)?", r"(?:www )?apache org licenses license 2 0", r"apache 2 0 license", r"apache 2 license", r"licensed under the apache 2(?: 0)?"]),
    ("apache", ["apache"], [r"apache (?:software |public )?licen[cs]e", r"(?:www )?apache org licenses"]),
    ("apache-2.0", ["asl"], [r"asl 2 0"]),
    ("mit", ["mit"], [r"(?:the )?mit licen[cs]e", r"mit x11 license", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?mit", r"opensource org licenses mit(?: license)?", r"mit style license", r"expat mit", r"mit licen[cs]ed"]),
    ("mit", ["granted"], [r"permission is hereby granted free of charge to any person obtaining a copy"]),
    ("mit", ["permission", "copies"], [r"the above copyright notice and this permission notice shall be included in all copies"]),
    ("mit", ["expat"], [r"expat license"]),
    ("mit-0", ["attribution"], [r"mit no attribution(?: license)?"]),
    ("mit-0", ["mit", "0"], [r"mit 0 licen[cs]e", r"licensed under (?:the )?mit 0"]),
    ("bsd-2-clause", ["bsd"], [r"bsd 2 clause(?: license)?", r"2 clause bsd(?: license)?", r"simplified bsd license"]),
    ("bsd-2-clause", ["freebsd"], [r"freebsd license"]),
    ("bsd-3-clause", ["bsd"], [r"bsd 3 clause(?: license)?", r"3 clause bsd(?: license)?", r"(?:new|modified|revised) bsd license", r"opensource org licenses bsd 3 clause"]),
    ("bsd-4-clause", ["bsd"], [r"bsd 4 clause(?: license)?", r"4 clause bsd(?: license)?", r"original bsd license"]),
    ("0bsd", ["bsd"], [r"(?:zero clause|0 clause|0) bsd(?: license)?"]),
    ("bsd", ["bsd"], [r"bsd licen[cs]e", r"bsd style license", r"licensed under (?:the )?bsd"]),
    ("bsd", ["redistribution"], [r"redistribution and use in source and binary forms with or without modification are permitted"]),
    ("bsd-3-clause", ["endorse"], [r"neither the name of .{1,80}? may be used to endorse or promote products derived from this software"]),
    ("isc", ["isc"], [r"(?:the )?isc license", r"licensed under (?:the )?isc", r"opensource org licenses isc"]),
    ("isc", ["granted"], [r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"]),
    ("mpl-1.1", ["mozilla"], [rf"mozilla public license{_V} 1 1"]),
    ("mpl-2.0", ["mozilla"], [rf"mozilla public license{_V} ?2(?: 0)?", r"mozilla org (?:mpl|mpl 2 0)"]),
    ("mpl", ["mozilla"], [r"mozilla public license"]),
    ("mpl-2.0", ["mpl"], [r"mpl 2 0", r"mpl license"]),
    ("epl-1.0", ["eclipse"], [rf"eclipse public license{_V} ?1(?: 0)?"]),
    ("epl-2.0", ["eclipse"], [rf"eclipse public license{_V} ?2(?: 0)?"]),
    ("epl", ["eclipse"], [r"eclipse public license"]),
    ("cddl-1.0", ["cddl"], [r"cddl(?: license)?(?: 1 [01])?"]),
    ("cddl-1.0", ["distribution"], [r"common development and distribution license"]),
    ("cpl-1.0", ["common"], [rf"common public license(?:{_V} 1 0)?"]),
    ("eupl-1.2", ["eupl"], [r"eupl(?: v?1 [12])?"]),
    ("eupl-1.2", ["european"], [r"european union public licen[cs]e"]),
    ("artistic-2.0", ["artistic"], [rf"artistic license{_V} ?2(?: 0)?"]),
    ("artistic", ["artistic"], [r"artistic license"]),
    ("artistic", ["perl", "itself"], [r"same terms as perl itself"]),
    ("zlib", ["zlib"], [r"zlib (?:libpng )?license"]),
    ("boost-1.0", ["boost"], [rf"boost software license(?:{_V} 1 0)?"]),
    ("unlicense", ["unlicense"], [r"(?:the )?unlicense", r"unlicense org"]),
    ("public-domain", ["domain"], [r"(?:released|placed|dedicated) (?:in)?to the public domain", r"this is free and unencumbered software released into the public domain", r"public domain dedication"]),
    ("wtfpl", ["wtfpl"], [r"wtfpl(?: license)?"]),
    ("python-2.0", ["python"], [r"python software foundation license(?: version 2)?"]),
    ("python-2.0", ["psf"], [r"psf license"]),
    ("php-3.01", ["php"], [r"php license(?: version 3 01?)?"]),
    ("ruby", ["ruby"], [r"ruby license", r"same license as ruby"]),
    ("openssl", ["openssl"], [r"openssl license"]),
    ("ofl-1.1", ["ofl"], [r"sil ofl(?: 1 1)?", r"ofl 1 1"]),
    ("ofl-1.1", ["font"], [rf"(?:sil )?open font license(?:{_V} 1 1)?"]),
    ("osl-3.0", ["open"], [rf"open software license(?:{_V} 3 0)?"]),
    ("ms-pl", ["microsoft"], [r"microsoft public license"]),
    ("ms-rl", ["microsoft"], [r"microsoft reciprocal license"]),
    ("odbl", ["database"], [r"open database licen[cs]e(?: odbl)?"]),
    ("odbl", ["odbl"], [r"odbl(?: 1 0)?"]),
    ("cc0-1.0", ["cc0"], [r"cc0(?: 1 0)?(?: universal)?"]),
    ("cc0-1.0", ["creativecommons"], [r"creativecommons org publicdomain zero(?: 1 0)?"]),
    ("cc-by-nc-sa", ["cc"], [r"cc by nc sa(?: \d \d)?"]),
    ("cc-by-nc-nd", ["cc"], [r"cc by nc nd(?: \d \d)?"]),
    ("cc-by-nc", ["cc"], [r"cc by nc(?: \d \d)?"]),
    ("cc-by-sa", ["cc"], [r"cc by sa(?: \d \d)?"]),
    ("cc-by-nd", ["cc"], [r"cc by nd(?: \d \d)?"]),
    ("cc-by", ["cc"], [r"cc by(?: \d \d)?"]),
    ("cc-by-nc-sa", ["creativecommons"], [r"creativecommons org licenses by nc sa(?: \d \d)?"]),
    ("cc-by-nc-nd", ["creativecommons"], [r"creativecommons org licenses by nc nd(?: \d \d)?"]),
    ("cc-by-nc", ["creativecommons"], [r"creativecommons org licenses by nc(?: \d \d)?"]),
    ("cc-by-sa", ["creativecommons"], [r"creativecommons org licenses by sa(?: \d \d)?"]),
    ("cc-by-nd", ["creativecommons"], [r"creativecommons org licenses by nd(?: \d \d)?"]),
    ("cc-by", ["creativecommons"], [r"creativecommons org licenses by(?: \d \d)?"]),
    ("cc-by-nc-sa", ["noncommercial"], [r"(?:creative commons )?attribution noncommercial share ?alike"]),
    ("cc-by-nc-nd", ["noncommercial"], [r"(?:creative commons )?attribution noncommercial noderiv(?:ative)?s"]),
    ("cc-by-nc", ["noncommercial"], [r"(?:creative commons )?attribution noncommercial"]),
    ("cc-by-sa", ["attribution"], [r"(?:creative commons )?attribution share ?alike"]),
    ("cc-by", ["attribution"], [r"creative commons attribution(?: \d \d)?(?: international)?(?: license)?"]),
    ("cc", ["creative"], [r"creative commons licen[cs]e", r"licensed under (?:a )?creative commons"]),
    ("all-rights-reserved", ["reserved"], [r"all rights reserved"]),
    ("proprietary", ["proprietary"], [r"proprietary and confidential", r"proprietary license"]),
    # notices and clauses of the licenses' own texts
    ("gpl", ["gnu", "redistribute"], [r"free software(?: you)? can redistribute it and or modify it under the terms of the gnu general public license"]),
    ("gpl", ["merchantability", "gnu"], [r"implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"]),
    ("gpl", ["received", "gnu"], [r"you should have received a copy of the gnu general public license along with (?:this|the) (?:program|library|file|software)"]),
    ("gpl", ["verbatim"], [r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"]),
    ("gpl-2.0", ["freedom", "licenses"], [r"the licenses for most software are designed to take away your freedom to share and change it"]),
    ("gpl-3.0", ["copyleft", "gnu"], [r"the gnu general public license is a free copyleft license for software and other kinds of works"]),
    ("gpl-3.0", ["covered", "propagate"], [r"to propagate a work means to do anything with it that without permission would make you directly or secondarily liable .{1,80}? covered work"]),
    ("lgpl", ["lesser", "redistribute"], [r"free software(?: you)? can redistribute it and or modify it under the terms of the gnu lesser general public license"]),
    ("lgpl", ["lesser", "received"], [r"you should have received a copy of the gnu lesser general public license along with (?:this|the) (?:program|library|file)"]),
    ("lgpl-3.0", ["incorporates", "gnu"], [r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"]),
    ("agpl-3.0", ["affero", "received"], [r"you should have received a copy of the gnu affero general public license along with this program"]),
    ("agpl-3.0", ["interacting", "remotely"], [r"all users interacting with it remotely through a computer network"]),
    ("gfdl", ["invariant"], [r"with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts"]),
    ("fsf-all-permissive", ["royalty", "medium"], [r"copying and distribution of this file with or without modification are permitted in any medium without royalty"]),
    ("gpl-classpath", ["linking", "exception"], [r"as a special exception the copyright holders of this library give you permission to link this library .{1,60}? linking"]),
    ("gpl-autoconf", ["autoconf", "exception"], [r"as a special exception .{1,80}? configuration script generated by autoconf"]),
    ("apache-2.0", ["compliance", "license"], [r"you may not use this file except in compliance with the license"]),
    ("apache-2.0", ["basis", "conditions"], [r"distributed on an as is basis without warranties or conditions of any kind either express or implied"]),
    ("apache-2.0", ["perpetual", "contributor"], [r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license"]),
    ("apache", ["asf"], [r"licensed to the apache software foundation asf under one or more contributor license agreements"]),
    ("apache-1.1", ["apache", "includes"], [r"this product includes software developed by the apache (?:software foundation|group)"]),
    ("mit", ["sublicense"], [r"(?:to )?use copy modify merge publish distribute sublicense and or sell copies of the software"]),
    ("mit", ["noninfringement"], [r"warranties of merchantability fitness for a particular purpose and noninfringement"]),
    ("mit-advertising", ["advertising", "authorization"], [r"shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization"]),
    ("mit-cmu", ["cmu"], [r"(?:mit )?cmu license", r"cmu style license"]),
    ("x11", ["x11"], [r"x11 license", r"x11 style license"]),
    ("hpnd", ["historical"], [r"historical permission notice and disclaimer"]),
    ("hpnd", ["pertaining"], [r"advertising or publicity pertaining to distribution of the software without specific written prior permission"]),
    ("bsd", ["redistributions", "retain"], [r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"]),
    ("bsd", ["redistributions", "reproduce"], [r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"]),
    ("bsd", ["exemplary"], [r"liable for any direct indirect incidental special exemplary or consequential damages"]),
    ("bsd-4-clause", ["advertising", "acknowledgement"], [r"all advertising materials mentioning features or use of this software must display the following acknowledgement"]),
    ("bsd-4-clause", ["berkeley"], [r"this product includes software developed by the university of california berkeley"]),
    ("bsd-3-clause-clear", ["patent", "granted"], [r"no express or implied licenses to any party s patent rights are granted by this license"]),
    ("bsd-2-clause-patent", ["patent", "bsd"], [r"bsd 2 clause plus patent(?: license)?"]),
    ("bsd-source-code", ["bsd"], [r"bsd source code attribution"]),
    ("isc", ["disclaims"], [r"the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"]),
    ("ncsa", ["ncsa"], [r"(?:university of illinois )?ncsa open source license"]),
    ("zlib", ["misrepresented"], [r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"]),
    ("zlib", ["altered"], [r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"]),
    ("libpng", ["libpng"], [r"libpng license(?: version 2)?"]),
    ("bzip2", ["bzip2"], [r"bzip2(?: and libbzip2)? license"]),
    ("ijg", ["jpeg"], [r"this software is based in part on the work of the independent jpeg group"]),
    ("libtiff", ["libtiff"], [r"libtiff license"]),
    ("freetype", ["freetype"], [r"freetype (?:project )?license", r"portions of this software are copyright .{1,40}? the freetype project"]),
    ("curl", ["curl"], [r"curl license"]),
    ("icu", ["icu"], [r"icu license"]),
    ("unicode", ["unicode"], [r"unicode (?:terms of use|license agreement|license v3)"]),
    ("info-zip", ["info", "zip"], [r"info zip license"]),
    ("tcl", ["tcl"], [r"tcl tk license", r"tcl license"]),
    ("vim", ["vim"], [r"vim license"]),
    ("postgresql", ["postgresql"], [r"postgresql licen[cs]e"]),
    ("postgresql", ["fee", "agreement"], [r"for any purpose without fee and without a written agreement is hereby granted"]),
    ("openldap", ["openldap"], [r"openldap public license"]),
    ("openssl", ["eric", "openssl"], [r"openssl .{1,60}? cryptographic software written by eric young"]),
    ("ssleay", ["ssleay"], [r"(?:original )?ssleay license"]),
    ("w3c", ["w3c"], [r"w3c (?:software notice and license|software and document license|document license)"]),
    ("sleepycat", ["sleepycat"], [r"sleepycat license"]),
    ("qpl-1.0", ["qpl"], [r"qpl(?: 1 0)? license", r"qpl 1 0"]),
    ("qpl-1.0", ["public", "q"], [r"q public license(?: version 1 0)?"]),
    ("cecill-2.1", ["cecill"], [r"(?:licence|license) cecill(?: version)?(?: 2 1)?", r"cecill(?: free software)? license(?: agreement)?"]),
    ("cecill-b", ["cecill"], [r"cecill b(?: license)?"]),
    ("cecill-c", ["cecill"], [r"cecill c(?: license)?"]),
    ("afl-3.0", ["academic"], [r"academic free license(?: version)?(?: 3 0)?"]),
    ("ecl-2.0", ["educational"], [r"educational community license(?: version)?(?: 2 0)?"]),
    ("ipl-1.0", ["ibm"], [r"ibm public license(?: version)?(?: 1 0)?"]),
    ("lppl", ["latex"], [r"latex project public license(?: version)?(?: 1 3c?)?"]),
    ("lppl", ["lppl"], [r"lppl(?: version)? 1 3c?", r"lppl maintenance status"]),
    ("nasa-1.3", ["nasa"], [r"nasa open source agreement(?: version)?(?: 1 3)?"]),
    ("rpl-1.5", ["reciprocal"], [r"reciprocal public license(?: version)?(?: 1 [15])?"]),
    ("apsl-2.0", ["apple"], [r"apple public source license(?: version)?(?: 2 0)?"]),
    ("spl-1.0", ["sun"], [r"sun public license(?: version)?(?: 1 0)?"]),
    ("sissl", ["sun"], [r"sun industry standards source license"]),
    ("watcom-1.0", ["watcom"], [r"sybase open watcom public license"]),
    ("intel-acpi", ["intel"], [r"intel acpi (?:software )?license", r"intel open source license"]),
    ("upl-1.0", ["permissive", "universal"], [r"universal permissive license(?: version| v)?(?: 1 0)?"]),
    ("blueoak-1.0.0", ["oak"], [r"blue oak model license(?: 1 0 0)?"]),
    ("mulan-2.0", ["mulan"], [r"mulan (?:permissive software license|psl)(?: v2| version 2)?"]),
    ("eupl-1.2", ["eupl"], [r"licensed under the eupl(?: version)?(?: 1 2)?"]),
    ("eclipse-distribution", ["eclipse"], [r"eclipse distribution license(?: v)?(?: 1 0)?"]),
    ("epl", ["accompanying", "eclipse"], [r"this program and the accompanying materials are made available under the terms of the eclipse public license"]),
    ("mpl-2.0", ["mozilla", "source"], [r"this source code form is subject to the terms of the mozilla public license"]),
    ("mpl-2.0", ["mpl", "obtain"], [r"if a copy of the mpl was not distributed with this file you can obtain one at"]),
    ("mpl-1.1", ["covered", "rights"], [r"see the license for the specific language governing rights and limitations under the license .{1,80}? covered code", r"covered code is provided under this license .{1,40}? rights"]),
    ("cddl-1.0", ["cddl", "obtain"], [r"you can obtain a copy of the (?:license|cddl) at .{1,60}? cddl"]),
    ("boost-1.0", ["boost", "org"], [r"boost org license 1 0(?: txt)?"]),
    ("boost-1.0", ["machine", "executable"], [r"unless such copies or derivative works are solely in the form of machine executable object code"]),
    ("unlicense", ["compile", "anyone"], [r"anyone is free to copy modify publish use compile sell or distribute this software"]),
    ("wtfpl", ["want", "public"], [r"do what the (?:fuck|hell) you want to public license"]),
    ("beerware", ["beer"], [r"beer ware license", r"you can buy me a beer in return"]),
    ("beerware", ["beerware"], [r"beerware license"]),
    ("json", ["evil"], [r"the software shall be used for good not evil"]),
    ("python-2.0", ["psf", "basis"], [r"psf is making python available to licensee on an as is basis"]),
    ("python-2.0", ["cnri"], [r"cnri (?:open source )?license agreement"]),
    ("artistic", ["artistic", "clarified"], [r"clarified artistic license"]),
    ("artistic", ["intent", "package"], [r"the intent of this document is to state the conditions under which a package may be copied"]),
    ("ruby", ["ruby", "dual"], [r"dual licensed under the ruby license"]),
    ("php-3.01", ["php", "includes"], [r"this product includes php(?: software)?"]),
    ("zend-2.0", ["zend"], [r"zend (?:engine )?license(?: version)?(?: 2 00?)?"]),
    ("ofl-1.1", ["font", "sil"], [r"this font software is licensed under the sil open font license"]),
    ("ofl-1.1", ["reserved", "font"], [r"with reserved font name"]),
    ("bitstream-vera", ["vera"], [r"bitstream vera (?:fonts )?(?:copyright|license)"]),
    ("ubuntu-font-1.0", ["ubuntu"], [r"ubuntu font licen[cs]e(?: version)?(?: 1 0)?"]),
    ("gust-font", ["gust"], [r"gust font license"]),
    # licenses of data and models
    ("odc-by-1.0", ["commons", "data"], [r"open data commons attribution license(?: v)?(?: 1 0)?"]),
    ("odc-by-1.0", ["odc"], [r"odc by(?: v)?(?: 1 0)?"]),
    ("pddl-1.0", ["commons", "dedication"], [r"open data commons public domain dedication and license"]),
    ("odbl", ["openstreetmap"], [r"openstreetmap contributors(?: odbl)?"]),
    ("ogl-3.0", ["government"], [r"open government licen[cs]e(?: v| version)?(?: ?3(?: 0)?)?"]),
    ("etalab-2.0", ["etalab"], [r"(?:etalab )?open licence etalab", r"licence ouverte etalab", r"etalab 2 0"]),
    ("dl-de-by-2.0", ["datenlizenz"], [r"datenlizenz deutschland(?: namensnennung)?(?: version)?(?: 2 0)?"]),
    ("cdla-permissive", ["community", "data", "permissive"], [r"community data license agreement permissive(?: version)?(?: [12] 0)?"]),
    ("cdla-sharing", ["community", "data", "sharing"], [r"community data license agreement sharing(?: version)?(?: 1 0)?"]),
    ("openrail", ["openrail"], [r"(?:bigscience |creativeml |creative ml |bigcode )?openrail(?: m)?(?: license)?"]),
    ("rail", ["responsible", "ai"], [r"responsible ai license"]),
    ("llama-community", ["llama"], [r"(?:meta )?llama(?: [23])?(?: \d)? community license(?: agreement)?"]),
    ("gemma", ["gemma"], [r"gemma terms of use", r"gemma license"]),
    ("research-only", ["research"], [r"for (?:non ?commercial )?research (?:use|purposes) only"]),
    ("cc0-1.0", ["waived"], [r"has waived all copyright and related or neighboring rights"]),
    ("cc0-1.0", ["creative", "zero"], [r"creative commons zero(?: v1 0| 1 0)?(?: universal)?"]),
    ("cc0-1.0", ["creative", "dedication"], [r"creative commons public domain dedication"]),
    ("cc-pdm", ["creativecommons", "mark"], [r"creativecommons org publicdomain mark(?: 1 0)?"]),
    ("cc-by-sa", ["wikipedia"], [r"text of this article from wikipedia", r"wikipedia .{1,40}? creative commons attribution share ?alike"]),
    ("cc-by", ["original", "properly"], [r"use distribution and reproduction in any medium provided the original work is properly cited"]),
    ("cc-by-nc", ["noncommercial", "medium"], [r"permits unrestricted noncommercial use distribution and reproduction in any medium"]),
    ("cc-by-nd", ["noderivs"], [r"(?:creative commons )?attribution noderivs"]),
    ("cc-by-nd", ["noderivatives"], [r"(?:creative commons )?attribution noderivatives"]),
    ("cc", ["cc"], [r"cc licensed", r"cc licen[cs]e"]),
    # source available, commercial and closed
    ("sspl-1.0", ["server", "public"], [r"server side public license(?: version)?(?: 1)?"]),
    ("sspl-1.0", ["sspl"], [r"sspl(?: v?1(?: 0)?)?"]),
    ("busl-1.1", ["business"], [r"business source license(?: version)?(?: 1 1)?"]),
    ("busl-1.1", ["busl"], [r"busl(?: 1 1)?"]),
    ("elastic-2.0", ["elastic"], [r"elastic license(?: v)?(?: ?2(?: 0)?)?"]),
    ("commons-clause", ["clause", "commons"], [r"commons clause(?: license)?(?: condition)?(?: v1 0)?"]),
    ("polyform", ["polyform"], [r"polyform (?:noncommercial|small business|strict|shield|perimeter|internal use|free trial) license"]),
    ("confluent-community", ["confluent"], [r"confluent community license(?: agreement)?"]),
    ("functional-source", ["functional"], [r"functional source license(?: version)?(?: 1 [01])?"]),
    ("hippocratic", ["hippocratic"], [r"hippocratic license(?: version)?(?: [23] [01])?"]),
    ("anti-996", ["996"], [r"anti 996 license(?: version)?(?: 1 0)?"]),
    ("parity", ["parity"], [r"parity public license(?: 7 0 0)?"]),
    ("prosperity", ["prosperity"], [r"prosperity public license(?: 3 0 0)?"]),
    ("dual-commercial", ["commercial", "dual"], [r"dual licensed under .{1,60}? commercial license"]),
    ("commercial", ["commercial"], [r"commercial license agreement", r"requires a commercial license"]),
    ("eula", ["end", "user"], [r"end user licen[cs]e agreement"]),
    ("freeware", ["freeware"], [r"this (?:software|program) is freeware", r"freeware license"]),
    ("shareware", ["shareware"], [r"this (?:software|program) is shareware", r"shareware license"]),
    ("proprietary", ["trade"], [r"contains (?:proprietary|confidential) information and trade secrets", r"unpublished proprietary trade secrets"]),
    ("proprietary", ["confidential"], [r"confidential and proprietary", r"strictly confidential"]),
    ("proprietary", ["unauthorized", "copying"], [r"unauthorized copying of this (?:file|software|document) (?:via any medium )?is strictly prohibited"]),
    ("proprietary", ["reproduced"], [r"no part of this (?:publication|book|document|work) may be reproduced", r"may not be reproduced (?:or distributed )?without (?:prior )?(?:written )?permission"]),
    ("proprietary", ["licensed", "property"], [r"licensed materials property of"]),
    ("proprietary", ["nvidia"], [r"nvidia proprietary", r"nvidia software license agreement"]),
    ("all-rights-reserved", ["droits"], [r"tous droits réservés"]),
    ("all-rights-reserved", ["rechte"], [r"alle rechte vorbehalten"]),
    ("all-rights-reserved", ["derechos"], [r"todos los derechos reservados"]),
    ("no-license", ["license", "unlicensed"], [r"(?:license )unlicensed"]),
    ("gpl", ["gpl", "compatible"], [r"gpl compatible(?: free software)? license"]),
    ("public-domain", ["domain", "hereby"], [r"hereby (?:placed|released|dedicated) (?:in|into|to) the public domain"]),
    ("public-domain", ["domain", "government"], [r"work of the (?:u s|united states) government .{1,60}? public domain"]),
    # machine-readable tags
    ("gpl-2.0", ["spdx", "gpl"], [r"spdx license identifier gpl 2 0(?: only| or later)?"]),
    ("gpl-3.0", ["spdx", "gpl"], [r"spdx license identifier gpl 3 0(?: only| or later)?"]),
    ("lgpl-2.1", ["spdx", "lgpl"], [r"spdx license identifier lgpl 2 1(?: only| or later)?"]),
    ("lgpl-3.0", ["spdx", "lgpl"], [r"spdx license identifier lgpl 3 0(?: only| or later)?"]),
    ("agpl-3.0", ["spdx", "agpl"], [r"spdx license identifier agpl 3 0(?: only| or later)?"]),
    ("apache-2.0", ["spdx", "apache"], [r"spdx license identifier apache 2 0"]),
    ("mit-0", ["spdx", "mit", "0"], [r"spdx license identifier mit 0"]),
    ("mit", ["spdx", "mit"], [r"spdx license identifier mit"]),
    ("bsd-2-clause", ["spdx", "bsd", "2"], [r"spdx license identifier bsd 2 clause"]),
    ("bsd-3-clause", ["spdx", "bsd", "3"], [r"spdx license identifier bsd 3 clause"]),
    ("isc", ["spdx", "isc"], [r"spdx license identifier isc"]),
    ("mpl-2.0", ["spdx", "mpl"], [r"spdx license identifier mpl 2 0"]),
    ("epl-2.0", ["spdx", "epl"], [r"spdx license identifier epl 2 0"]),
    ("zlib", ["spdx", "zlib"], [r"spdx license identifier zlib"]),
    ("boost-1.0", ["spdx", "bsl"], [r"spdx license identifier bsl 1 0"]),
    ("unlicense", ["spdx", "unlicense"], [r"spdx license identifier unlicense"]),
    ("cc0-1.0", ["spdx", "cc0"], [r"spdx license identifier cc0 1 0"]),
    ("cc-by", ["spdx", "cc"], [r"spdx license identifier cc by \d 0"]),
    ("cc-by-sa", ["spdx", "cc", "sa"], [r"spdx license identifier cc by sa \d 0"]),
    ("mit", ["package", "mit"], [r"package license mit"]),
    ("apache-2.0", ["apache", "osi"], [r"license osi approved apache software license"]),
    ("mit", ["mit", "osi"], [r"license osi approved mit license"]),
    ("bsd", ["bsd", "osi"], [r"license osi approved bsd license"]),
    ("gpl", ["gnu", "osi"], [r"license osi approved gnu general public license(?: v2| v3)?(?: or later)?"]),
]


def rules() -> list[dict]:
    """The rules in order of priority: base phrases, then signatures."""
    out = [{"label": label, "needs": [phrase.split()[0], phrase.split()[-1]], "regex": phrase, "base": True} for phrase, label in BASE.items()]
    for label, needs, expressions in SIGNATURES:
        out += [{"label": label, "needs": needs, "regex": e, "base": False} for e in expressions]
    return [{"order": i, **r, "regex": rf"(?<= ){r['regex']}(?= )"} for i, r in enumerate(out)]


_RULE = "array<struct<order: int, label: string, needs: array<string>, regex: string, base: boolean>>"


_FOUND = "array<struct<start: int, upto: int, order: int, label: string, base: boolean>>"


#: SQL conditions: a text holds a mark, a word begins or ends with one. Words hold no control characters.
_MARKED, _BEGINS, _ENDS = r"contains(m, '\u0001')", r"startswith(w, '\u0001')", r"endswith(w, '\u0002')"


def _places(of: str) -> str:
    """SQL: places of words that begin (``of`` is a condition on ``w``) in the array of words ``ws``."""
    return f"filter(transform(ws, (w, i) -> if({of}, i, null)), i -> i is not null)"


def scan(docs: DataFrame, text_col: str = "text", table: list[dict] | None = None) -> DataFrame:
    """``docs`` with ``n_words``, ``found`` and ``detections``.

    ``found`` lists every place where a rule matches, as structs (start, upto, order, label,
    base) in words from 0, sorted by start, longest first, then rule. ``detections``
    is what stays: a place inside another one goes, of equal ones the later rule's; the others
    are gone through by rule, then by place, and one stays if it overlaps none that stays. Null and empty texts have no words, an empty table gives an empty one. Repeated rows stay as they
    are; input columns named like an output give way, others pass unchanged.
    """
    table = rules() if table is None else table
    keys = sorted({w for r in table for w in r["needs"]})
    some = F.size("_keys") >= (1 if all(r["needs"] for r in table) else 0)  # a rule without keywords is tried everywhere
    literal = F.from_json(F.lit(json.dumps(table)), _RULE)
    given = [c for c in docs.columns if c.lower() not in ("n_words", "found", "detections")]
    df = docs.select(F.struct(*given).alias("_given"), words(F.col(text_col)).alias("_w")) if given else docs.select(words(F.col(text_col)).alias("_w"))
    df = df.withColumn("_keys", F.array_distinct(F.filter("_w", lambda w: w.isin(keys)))).withColumn("n_words", F.size("_w").cast("long"))
    # Matches are marked in the text, so the place of a mark among the words is the place of the match: linear in the words.
    marked = r"regexp_replace(_text, r.regex, '\u0001$0\u0002')"
    place = "struct(a as start, -b - 1 as neg, r.order as order, r.label as label, r.base as base)"
    one = f"if({_MARKED}, flatten(transform(array(split(trim(m), ' ')), ws -> zip_with({_places(_BEGINS)}, {_places(_ENDS)}, (a, b) -> {place}))), array())"
    tried = "filter(_rules, r -> size(array_except(r.needs, _keys)) = 0)"
    every = f"sort_array(flatten(transform({tried}, r -> flatten(transform(array({marked}), m -> {one})))))"
    found = f"if(_text is null, cast(array() as {_FOUND}), transform({every}, x -> struct(x.start as start, -x.neg as upto, x.order as order, x.label as label, x.base as base)))"
    df = df.withColumn("_text", F.when(some, F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" ")))).withColumn("_rules", literal)
    carried = [c for c in df.columns if c in ("_given", "n_words")]
    df = df.select(*carried, F.expr(found).alias("found"))
    # A place stays if it reaches beyond all before it. The running maximum goes block by block of the square root of their number.
    size = "cast(ceil(sqrt(size(found))) as int)"
    df = df.withColumn("_blocks", F.expr(f"if(size(found) = 0, array(), transform(sequence(0, size(found) - 1, {size}), i -> slice(found, i + 1, {size})))"))
    df = df.withColumn("_reach", F.expr("transform(_blocks, b -> array_max(transform(b, x -> x.upto)))"))
    inside = f"aggregate(b, struct(coalesce(array_max(slice(_reach, 1, i)), -1) as far, cast(array() as {_FOUND}) as out), (a, x) -> if(x.upto <= a.far, a, struct(x.upto as far, concat(a.out, array(x)) as out)), a -> a.out)"
    df = df.withColumn("_outer", F.expr(f"flatten(transform(_blocks, (b, i) -> {inside}))"))
    # Places have ascending ends by now, so those that hang together by overlaps follow each other; each such chain is resolved by itself.
    begins = "filter(transform(_outer, (x, i) -> if(i = 0 or get(_outer, i - 1).upto <= x.start, i, null)), i -> i is not null)"
    chains = "transform(_begins, (s, j) -> slice(_outer, s + 1, coalesce(get(_begins, j + 1), size(_outer)) - s))"
    ordered = "sort_array(transform(c, x -> struct(x.order as by, x.start as at, x as x)))"
    free = "not exists(a, k -> k.start < p.x.upto and p.x.start < k.upto)"
    kept = f"if(size(c) = 1, c, aggregate({ordered}, cast(array() as {_FOUND}), (a, p) -> if({free}, concat(a, array(p.x)), a)))"
    df = df.withColumn("_begins", F.expr(begins))
    kept = F.expr(f"sort_array(flatten(transform({chains}, c -> {kept})))")
    return df.select(*([F.col("_given")[c].alias(c) for c in given]), "n_words", "found", kept.alias("detections"))


#: SQL: how sure a text holds a license. A detection of n words stands for n / (n + 2), and each one leaves its share of the doubt.
_SCORE = "aggregate(detections, 1.0D, (d, x) -> d * 2.0D / (x.upto - x.start + 2.0D), d -> 1.0D - d)"


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op3_license_scan`` that SQL can express."""
    return op3_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = scan(docs).withColumn("_base", F.expr("filter(found, x -> x.base)"))
    base = "array_distinct(transform(_base, x -> x.label))"
    return done.select(
        "doc_id",
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.expr("array_min(transform(_base, x -> x.start))").cast("long").alias("first_word"),
        F.expr("array_max(transform(_base, x -> x.start))").cast("long").alias("last_word"),
        F.expr(f"array_join(array_sort({base}), ',')").alias("base_labels"),
        F.expr(f"array_join(array_sort(array_union({base}, transform(detections, x -> x.label))), ',')").alias("labels"),
        F.expr(_SCORE).alias("score"),
    )


#: The contract's part of the result, which SQL can express; the other columns are the method's own.
BASE_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), p AS (
  SELECT * FROM (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')) t(ph, label)
), hit AS (
  SELECT doc_id, label, unnest(list_filter(range(1, len(w) - len(ph) + 2), lambda i: w[i:i + len(ph) - 1] = ph)) - 1 AS pos FROM w, p
), g AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM hit GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels
FROM w LEFT JOIN g USING (doc_id)
"""
