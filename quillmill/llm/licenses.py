"""License detection by ordered signature rules.

Texts become lower-case words set apart by single spaces. Each rule is a regular expression over them with keywords,
a priority and a confidence; a text is searched for keywords once, and only rules of which it has a keyword are tried.
A detection that lies within another of higher priority, or of its own priority but longer or earlier in the rules, goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillmill.llm.common import lower_ascii

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed values of the contract: phrases and labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Label, keywords, and how the license is named in words; names that mean nothing without "license" have a * before them.
#: Whatever a name matches has one of its keywords, set apart by |, as a whole word.
FAMILIES = (
    ("0bsd", "bsd|0bsd", r"(?:zero clause|0 clause) bsd|0bsd|bsd zero clause"),
    ("aal", "attribution", r"attribution assurance"),
    ("afl-3", "academic", r"academic free(?: license)?(?: v| version)? ?3(?: 0)?"),
    ("agpl-3", "affero", r"(?:gnu )?affero general public(?: license)?(?: v| version)? ?3(?: 0)?"),
    ("agpl", "agpl|agpl3|agplv3", r"agpl(?: ?v?3(?: 0)?)?"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("apache-2", "apache|apache2", r"apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("apsl-2", "apple", r"apple public source(?: license)?(?: version)? 2(?: 0)?"),
    ("artistic-1", "artistic", r"artistic(?: license)?(?: version)? 1(?: 0)?"),
    ("artistic-2", "artistic", r"artistic(?: license)?(?: version)? 2(?: 0)?"),
    ("beerware", "beer|beerware", r"beer ?ware"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|2 clause|two clause) bsd|bsd 2(?: clause)?|bsd two clause"),
    ("bsd-3-clause", "bsd", r"(?:new|revised|modified|3 clause|three clause) bsd|bsd 3(?: clause)?|bsd three clause"),
    ("bsd-4-clause", "bsd", r"(?:original|old|4 clause|four clause) bsd|bsd 4(?: clause)?"),
    ("bsd", "bsd", r"*bsd(?: style)?"),
    ("bsl-1", "boost", r"boost software(?: license)?(?: version)? 1(?: 0)?"),
    ("busl-1.1", "business", r"business source(?: license)?(?: version)? 1 1"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", "cc", r"cc by(?! (?:nc|nd|sa) )(?: [1-4] [05])?"),
    ("cc-by-nc", "cc", r"cc by nc(?! (?:nd|sa) )(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by", "creative", r"creative commons attribution(?! (?:non|share|no) ?)(?: [1-4] [05])?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?! (?:share|no) ?)(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cddl-1", "common", r"common development and distribution(?: license)?(?: version)? 1(?: [01])?"),
    ("cecill-2.1", "cecill", r"cecill(?: [bc])?(?: 2 1| 2 0)?"),
    ("cpal-1", "common", r"common public attribution(?: license)?(?: version)? 1(?: 0)?"),
    ("cpl-1", "common", r"common public(?: license)?(?: version)? 1(?: 0)?"),
    ("ecl-2", "educational", r"educational community(?: license)?(?: version)? 2(?: 0)?"),
    ("epl-1", "eclipse", r"eclipse public(?: license)?(?: version| v)? 1(?: 0)?"),
    ("epl-2", "eclipse", r"eclipse public(?: license)?(?: version| v)? 2(?: 0)?"),
    ("eupl-1.2", "european", r"european union public licen[cs]e(?: v| version)? ?1 [12]"),
    ("fdl-1.3", "documentation", r"(?:gnu )?free documentation(?: license)?(?: version)? 1 [123]"),
    ("gpl-1", "gpl|gpl1|gplv1", r"gpl ?v?1(?: 0)?"),
    ("gpl-2", "gpl|gpl2|gplv2", r"gpl ?v?2(?: 0)?"),
    ("gpl-3", "gpl|gpl3|gplv3", r"gpl ?v?3(?: 0)?"),
    ("gpl-2", "gnu", r"gnu general public(?: license)?(?: as published by the free software foundation)?(?: either)?(?: v| version)? ?2(?: 0)?"),
    ("gpl-3", "gnu", r"gnu general public(?: license)?(?: as published by the free software foundation)?(?: either)?(?: v| version)? ?3(?: 0)?"),
    ("gpl", "gnu", r"gnu (?:general public|gpl)"),
    ("hpnd", "permission", r"historical permission notice and disclaimer"),
    ("ijg", "jpeg", r"independent jpeg group"),
    ("imagemagick", "imagemagick", r"*imagemagick"),
    ("intel", "intel", r"*intel open source"),
    ("ipl-1", "ibm", r"ibm public(?: license)?(?: version)? 1(?: 0)?"),
    ("isc", "isc", r"*isc"),
    ("json", "json", r"*json"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public(?: license)?(?: v| version)? ?2 1"),
    ("lgpl-3", "lesser", r"(?:gnu )?lesser general public(?: license)?(?: v| version)? ?3(?: 0)?"),
    ("lgpl-2", "library", r"(?:gnu )?library general public(?: license)?(?: v| version)? ?2(?: 0)?"),
    ("lgpl", "lgpl|lgpl2|lgpl3|lgplv2|lgplv3", r"lgpl(?: ?v?[23](?: [01])?)?"),
    ("libpng", "libpng", r"*(?:zlib )?libpng"),
    ("lpl-1.02", "lucent", r"lucent public(?: license)?(?: version)? 1 02"),
    ("lppl-1.3", "latex", r"latex project public(?: license)?(?: version)? 1 3(?: [abc])?"),
    ("mit", "mit", r"*mit(?: expat| x11)?"),
    ("mit-0", "mit", r"mit no attribution|mit 0"),
    ("mpl-1.1", "mozilla", r"mozilla public(?: license)?(?: version| v)? ?1 1"),
    ("mpl-2", "mozilla", r"mozilla public(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("ms-pl", "microsoft", r"microsoft public"),
    ("ms-rl", "microsoft", r"microsoft reciprocal"),
    ("mulanpsl-2", "mulan", r"mulan permissive software(?: license)?(?: v| version)? ?2"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("odbl-1", "database|database1", r"open (?:data commons )?(?:open )?database(?: license)?(?: v| version)? ?1(?: 0)?"),
    ("odc-by-1", "commons", r"open data commons attribution(?: license)?(?: v)? ?1(?: 0)?"),
    ("ofl-1.1", "font", r"(?:sil )?open font(?: license)?(?: version)? 1 [01]"),
    ("openssl", "openssl", r"*openssl"),
    ("osl-3", "open", r"open software(?: license)?(?: v| version)? ?3(?: 0)?"),
    ("pddl-1", "public", r"public domain dedication and licen[cs]e"),
    ("php-3", "php", r"php(?: license)?(?: version)? 3(?: 0?1)?"),
    ("postgresql", "postgresql", r"*postgresql"),
    ("psf-2", "python", r"python software foundation(?: license)?(?: version)?(?: 2)?"),
    ("public-domain", "public", r"(?:released|dedicated|placed) (?:in|into|to) the public domain"),
    ("qpl-1", "q", r"q public(?: license)?(?: version)? 1(?: 0)?"),
    ("ruby", "ruby", r"*ruby"),
    ("sleepycat", "sleepycat", r"*sleepycat"),
    ("sspl-1", "server", r"server side public(?: license)?(?: v| version)? ?1"),
    ("unicode", "unicode", r"*unicode"),
    ("unlicense", "unlicense", r"unlicense"),
    ("upl-1", "universal", r"universal permissive(?: license)?(?: v| version)? ?1(?: 0)?"),
    ("vim", "vim", r"*vim"),
    ("w3c", "w3c", r"*w3c(?: software)?(?: notice and)?"),
    ("wtfpl", "wtfpl", r"wtfpl(?: v(?:ersion)? ?2)?"),
    ("x11", "x11", r"*x11"),
    ("zlib", "zlib", r"*zlib"),
    ("zpl-2.1", "zope", r"zope public(?: license)?(?: version)? 2 1"),
)
#: Ways to name a license in words, as (priority, confidence, pattern), {} being the name.
GRANT = r"(?:licen[cs]ed|released|distributed|redistributed|available|published|provided|covered|made available) (?:under|by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{}(?: (?:public )?licen[cs]e)?"
WAYS = ((3, 0.95, GRANT), (2, 0.8, r"(?:the )?{} licen[cs]e"), (1, 0.5, r"{}"))
#: Rules with wording of their own, as (label, keywords, priority, confidence, pattern): sentences, addresses, tags and names.
TEXTS = (
    ("mit", "mit", 4, 1.0, r"(?:released |licensed |distributed )?under the mit licen[cs]e"),
    ("mit", "permission", 4, 1.0, r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?"),
    ("mit", "permission", 4, 1.0, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", "sublicense", 4, 1.0, r"the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "opensource", 4, 1.0, r"opensource org licenses? mit(?: license)?"),
    ("mit-0", "opensource", 4, 1.0, r"opensource org licenses? mit 0"),
    ("isc", "permission", 4, 1.0, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "permission", 4, 1.0, r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "opensource", 4, 1.0, r"opensource org licenses? isc(?: license)?"),
    ("hpnd", "permission", 4, 1.0, r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and without fee)? is hereby granted"),
    ("ntp", "permission", 4, 1.0, r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("x11", "advertising", 4, 1.0, r"except as contained in this notice the names? of [^ ]+(?: [^ ]+){0,8} shall not be used in advertising or otherwise"),
    ("bsd", "redistribution", 4, 1.0, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", 4, 1.0, r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", 4, 1.0, r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-2-clause", "opensource", 4, 1.0, r"opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", "opensource", 4, 1.0, r"opensource org licenses? bsd 3 clause"),
    ("bsd-3-clause", "endorse", 4, 1.0, r"neither the name of [^ ]+(?: [^ ]+){0,8} nor the names of its contributors may be used to endorse"),
    ("bsd-3-clause", "endorse", 4, 0.9, r"may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", 4, 1.0, r"all advertising materials mentioning features or use of this software must display"),
    ("bsd-3-clause-clear", "patent", 4, 0.9, r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("apache-2", "apache", 4, 1.0, r"(?:licensed under the )?apache license version 2(?: 0)?"),
    ("apache-2", "apache", 4, 1.0, r"(?:http|https) www apache org licenses license 2 0"),
    ("apache-2", "compliance", 4, 1.0, r"you may not use this file except in compliance with the license"),
    ("apache-2", "applicable", 4, 1.0, r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-1.1", "apache", 4, 1.0, r"this product includes software developed by the apache (?:software foundation|group)"),
    ("cc-by-nc", "cc", 4, 0.9, r"cc by nc(?! (?:nd|sa) )(?: [1-4] [05])?"),
    ("cc-by", "creativecommons", 4, 1.0, r"creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "creativecommons", 4, 1.0, r"creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nc", "creativecommons", 4, 1.0, r"creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nd", "creativecommons", 4, 1.0, r"creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons", 4, 1.0, r"creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons", 4, 1.0, r"creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc0", "creativecommons", 4, 1.0, r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons", 4, 1.0, r"creativecommons org publicdomain mark 1 0"),
    ("cc0", "waived", 4, 1.0, r"has waived all copyright and related or neighbou?ring rights"),
    ("cc0", "dedicated", 4, 0.95, r"has dedicated the work to the public domain by waiving all of his or her rights"),
    ("cc", "commons", 1, 0.5, r"creative commons licen[cs]e"),
    ("cc-sampling-plus", "sampling", 2, 0.8, r"creative commons sampling plus(?: 1 0)?"),
    ("gpl", "gnu", 4, 1.0, r"under the terms of the gnu general public license"),
    ("gpl", "gnu", 4, 1.0, r"you should have received a copy of the gnu general public license"),
    ("gpl-2", "later", 4, 0.9, r"either version 2 of the license or (?:at your option )?any later version"),
    ("gpl-3", "later", 4, 0.9, r"either version 3 of the license or (?:at your option )?any later version"),
    ("gpl-2", "gnu", 4, 1.0, r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3", "gnu", 4, 1.0, r"gnu org licenses gpl 3 0"),
    ("gpl-2-classpath", "statically", 4, 1.0, r"linking this library statically or dynamically with other modules is making a combined work"),
    ("gpl-3-gcc", "gcc", 4, 1.0, r"gcc runtime library exception"),
    ("gpl-2-bison", "bison", 4, 0.9, r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("lgpl", "gnu", 4, 1.0, r"under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "gnu", 4, 1.0, r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl", "library", 4, 0.9, r"this library is free software you can redistribute it and or modify it"),
    ("lgpl-2.1", "gnu", 4, 1.0, r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3", "gnu", 4, 1.0, r"gnu org licenses lgpl 3 0"),
    ("agpl", "gnu", 4, 1.0, r"you should have received a copy of the gnu affero general public license"),
    ("agpl-3", "gnu", 4, 1.0, r"gnu org licenses agpl 3 0"),
    ("agpl-3", "remotely", 4, 0.9, r"all users interacting with it remotely through a computer network"),
    ("fdl-1.3", "gnu", 4, 1.0, r"gnu org licenses fdl 1 3"),
    ("fdl", "document", 4, 1.0, r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("fsfap", "royalty", 4, 1.0, r"copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    ("fsful", "configure", 4, 1.0, r"this configure script is free software the free software foundation gives unlimited permission"),
    ("fsfullr", "unlimited", 4, 0.9, r"gives unlimited permission to copy and or distribute it with or without modifications"),
    ("mpl-2", "mozilla", 4, 1.0, r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "mpl", 4, 1.0, r"if a copy of the mpl was not distributed with this file"),
    ("mpl-2", "mozilla", 4, 1.0, r"mozilla org mpl 2 0"),
    ("mpl-2-no-copyleft", "incompatible", 4, 1.0, r"this source code form is incompatible with secondary licenses"),
    ("mpl-1.1", "mozilla", 4, 1.0, r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("npl-1.1", "netscape", 3, 0.95, r"netscape public license(?: version)?(?: 1 [01])?"),
    ("epl-1", "eclipse", 4, 1.0, r"eclipse org (?:legal|org documents) epl v10"),
    ("epl-2", "eclipse", 4, 1.0, r"eclipse org legal epl (?:2 0|v20)"),
    ("cddl-1", "cddl", 4, 0.95, r"(?:under the|of the) cddl(?: v?1 [01])?"),
    ("unlicense", "unencumbered", 4, 1.0, r"free and unencumbered software released into the public domain"),
    ("unlicense", "compile", 4, 1.0, r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", "unlicense", 4, 1.0, r"unlicense org"),
    ("wtfpl", "want", 4, 0.95, r"do what the fuck you want to"),
    ("zlib", "altered", 4, 1.0, r"altered source versions must be plainly marked as such"),
    ("zlib", "misrepresented", 4, 1.0, r"the origin of this software must not be misrepresented"),
    ("zlib", "commercial", 4, 1.0, r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("bsl-1", "organization", 4, 1.0, r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("bsl-1", "boost", 4, 1.0, r"boost org license 1 0 txt"),
    ("openssl", "openssl", 4, 1.0, r"this product includes software developed by the openssl project"),
    ("ssleay", "cryptographic", 4, 1.0, r"this product includes cryptographic software written by eric young"),
    ("artistic-1", "artistic", 4, 1.0, r"the copyright holder maintains some semblance of artistic control over the development of the package"),
    ("artistic-2", "artistic", 4, 1.0, r"opensource org licenses? artistic(?: license)? 2 0"),
    ("perl", "perl", 4, 0.95, r"under the same terms as perl(?: 5)?(?: itself)?"),
    ("psf-2", "psf", 4, 1.0, r"psf is making python available to licensee on an as is basis"),
    ("postgresql", "postgres", 4, 0.9, r"postgres data base management system formerly known as postgres95"),
    ("ofl-1.1", "sil", 4, 1.0, r"this font software is licensed under the sil open font license"),
    ("ofl-1.1", "ofl", 4, 1.0, r"scripts sil org ofl"),
    ("eupl-1.2", "eupl", 3, 0.95, r"(?:licensed under|terms of) the eupl(?: v?1 [12])?"),
    ("cecill-2.1", "cecill", 4, 1.0, r"governed by the cecill(?: [bc])? license under french law"),
    ("ms-pl", "bear", 4, 0.9, r"the software is licensed as is you bear the risk of using it"),
    ("json", "evil", 4, 1.0, r"the software shall be used for good not evil"),
    ("beerware", "beer", 4, 1.0, r"you think this stuff is worth it you can buy me a beer in return"),
    ("blessing", "blessing", 4, 1.0, r"in place of a legal notice here is a blessing"),
    ("public-domain", "domain", 4, 0.9, r"this (?:work|file|code|software|document|text|program) is in the public domain"),
    ("public-domain", "government", 4, 0.9, r"is a work of the (?:us|u s|united states) government"),
    ("public-domain", "disclaims|disclaim", 4, 0.9, r"the authors? (?:hereby )?disclaims? copyright to this source code|disclaims copyright to this (?:work|file|text)"),
    ("sspl-1", "functionality", 4, 0.95, r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("busl-1.1", "production", 4, 0.95, r"create derivative works redistribute and make non production use of the licensed work"),
    ("elastic-2", "elastic", 3, 0.95, r"elastic license(?: version| v)? ?2(?: 0)?"),
    ("elastic-2", "hosted", 4, 0.95, r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "clause", 4, 0.95, r"commons clause(?: license)?(?: condition)?(?: v1 0)?"),
    ("polyform", "polyform", 3, 0.95, r"polyform (?:noncommercial|small business|free trial|internal use|shield|strict|perimeter)(?: license)?(?: 1 0 [01])?"),
    ("hippocratic-2.1", "hippocratic", 3, 0.9, r"hippocratic license(?: version)?(?: [123] [01])?"),
    ("blueoak-1", "oak", 3, 0.95, r"blue oak model license(?: version)?(?: 1 0 0)?"),
    ("anti-996", "996", 3, 0.95, r"anti 996 license(?: version)?(?: 1 0)?"),
    ("rpl-1.5", "reciprocal", 3, 0.9, r"reciprocal public license(?: version)?(?: 1 [15])?"),
    ("opl-1", "publication", 3, 0.95, r"open publication license(?: v| version)?(?: ?1 0)?"),
    ("nasa-1.3", "nasa", 3, 0.95, r"nasa open source agreement(?: version)?(?: 1 3)?"),
    ("nokia", "nokia", 3, 0.9, r"nokia open source license"),
    ("sissl", "sun", 3, 0.95, r"sun industry standards source license"),
    ("spl-1", "sun", 3, 0.9, r"sun public license(?: version)?(?: 1 0)?"),
    ("rpsl-1", "realnetworks", 3, 0.95, r"realnetworks public source license"),
    ("watcom-1", "watcom", 3, 0.95, r"sybase open watcom public license"),
    ("rscpl", "ricoh", 3, 0.95, r"ricoh source code public license"),
    ("ngpl", "nethack", 3, 0.95, r"nethack general public license"),
    ("ftl", "freetype", 3, 0.95, r"freetype (?:project )?license"),
    ("fair", "instrument", 4, 0.95, r"usage of the works is permitted provided that this instrument is retained with the works"),
    ("frameworx-1", "frameworx", 3, 0.95, r"frameworx open license"),
    ("motosoto", "motosoto", 3, 0.95, r"motosoto open source license"),
    ("multics", "multics", 2, 0.8, r"multics license"),
    ("naumen", "naumen", 3, 0.95, r"naumen public license"),
    ("oclc-2", "oclc", 3, 0.95, r"oclc research public license(?: 2 0)?"),
    ("simpl-2", "simple", 3, 0.9, r"simple public license(?: 2 0)?"),
    ("vsl-1", "vovida", 3, 0.95, r"vovida software license"),
    ("xnet", "net", 2, 0.8, r"x net license"),
    ("xfree86-1.1", "xfree86", 3, 0.95, r"xfree86 license(?: 1 1)?"),
    ("cua-opl", "cua", 3, 0.95, r"cua office public license"),
    ("entessa", "entessa", 3, 0.95, r"entessa public license"),
    ("efl-2", "eiffel", 3, 0.95, r"eiffel forum license(?: version)?(?: [12])?"),
    ("eudatagrid", "datagrid", 3, 0.95, r"eu datagrid software license"),
    ("miros", "miros", 3, 0.95, r"miros licen[cs]e"),
    ("curl", "curl", 2, 0.8, r"curl license"),
    ("libtiff", "libtiff", 2, 0.8, r"libtiff license"),
    ("icu", "icu", 2, 0.8, r"icu license(?: icu 1 8 1 and later)?"),
    ("info-zip", "info", 2, 0.8, r"info zip license"),
    ("tcl", "tcl", 2, 0.8, r"tcl (?:tk )?license"),
    ("zend-2", "zend", 3, 0.95, r"zend (?:engine )?license(?: version)?(?: 2 0)?"),
    ("ypl-1.1", "yahoo", 3, 0.95, r"yahoo public license(?: v)?(?: ?1 [01])?"),
    ("zimbra-1.4", "zimbra", 3, 0.95, r"zimbra public license(?: version)?(?: 1 [34])?"),
    ("bitstream-vera", "bitstream", 3, 0.9, r"bitstream vera (?:fonts? )?(?:copyright|license)"),
    ("ubuntu-font-1", "ubuntu", 3, 0.95, r"ubuntu font licen[cs]e(?: version)?(?: 1 0)?"),
    ("gust-font", "gust", 3, 0.95, r"gust font (?:source )?license"),
    ("cern-ohl-2", "cern", 3, 0.95, r"cern open hardware licen[cs]e(?: version)?(?: 2)?(?: (?:permissive|weakly reciprocal|strongly reciprocal))?"),
    ("tapr-ohl-1", "tapr", 3, 0.95, r"tapr open hardware license"),
    ("shl", "solderpad", 3, 0.95, r"solderpad hardware licen[cs]e"),
    ("etalab-2", "etalab", 3, 0.95, r"(?:etalab open licen[cs]e|licence ouverte etalab)(?: 2 0)?"),
    ("ogl-uk-3", "government", 3, 0.95, r"open government licen[cs]e(?: v| version)?(?: ?[123] 0)?"),
    ("dl-de-by-2", "datenlizenz", 3, 0.95, r"datenlizenz deutschland namensnennung(?: version)?(?: 2 0)?"),
    ("cdla-permissive-2", "community", 3, 0.95, r"community data license agreement permissive(?: version)?(?: [12] 0)?"),
    ("cdla-sharing-1", "community", 3, 0.95, r"community data license agreement sharing(?: version)?(?: 1 0)?"),
    ("openrail", "openrail", 3, 0.95, r"(?:creativeml |bigscience )?openrail(?: m)?(?: license)?"),
    ("rail", "rail", 3, 0.95, r"(?:creativeml open|bigscience) rail(?: m)?(?: license)?(?: v1 0)?"),
    ("llama-community", "llama", 3, 0.95, r"llama (?:[234](?: [0-9])? )?community license(?: agreement)?"),
    ("ncgl-uk-2", "commercial", 3, 0.9, r"non commercial government licen[cs]e"),
    ("mit", "identifier", 4, 1.0, r"spdx license identifier mit"),
    ("apache-2", "identifier", 4, 1.0, r"spdx license identifier apache 2 0"),
    ("gpl-2", "identifier", 4, 1.0, r"spdx license identifier gpl 2 0(?: only| or later)?"),
    ("gpl-3", "identifier", 4, 1.0, r"spdx license identifier gpl 3 0(?: only| or later)?"),
    ("lgpl-2.1", "identifier", 4, 1.0, r"spdx license identifier lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", "identifier", 4, 1.0, r"spdx license identifier lgpl 3 0(?: only| or later)?"),
    ("agpl-3", "identifier", 4, 1.0, r"spdx license identifier agpl 3 0(?: only| or later)?"),
    ("bsd-2-clause", "identifier", 4, 1.0, r"spdx license identifier bsd 2 clause"),
    ("bsd-3-clause", "identifier", 4, 1.0, r"spdx license identifier bsd 3 clause"),
    ("mpl-2", "identifier", 4, 1.0, r"spdx license identifier mpl 2 0"),
    ("isc", "identifier", 4, 1.0, r"spdx license identifier isc"),
    ("epl-2", "identifier", 4, 1.0, r"spdx license identifier epl 2 0"),
    ("cc0", "identifier", 4, 1.0, r"spdx license identifier cc0 1 0"),
    ("unlicense", "identifier", 4, 1.0, r"spdx license identifier unlicense"),
    ("bsl-1", "identifier", 4, 1.0, r"spdx license identifier bsl 1 0"),
    ("zlib", "identifier", 4, 1.0, r"spdx license identifier zlib"),
    ("0bsd", "identifier", 4, 1.0, r"spdx license identifier 0bsd"),
    ("spdx", "spdx", 1, 0.5, r"spdx license identifier"),
    ("all-rights-reserved", "rights", 2, 0.6, r"all rights reserved"),
    ("some-rights-reserved", "rights", 2, 0.6, r"some rights reserved"),
    ("no-rights-reserved", "rights", 2, 0.6, r"no rights reserved"),
    ("proprietary", "proprietary", 2, 0.6, r"proprietary and confidential|confidential and proprietary"),
    ("proprietary", "unauthorized|unauthorised", 2, 0.6, r"unauthori[sz]ed (?:copying|reproduction|distribution|use) of this (?:file|work|document|software|publication)"),
    ("proprietary", "reproduced", 2, 0.6, r"no part of this (?:publication|book|work|document) may be reproduced"),
    ("proprietary", "prohibited", 2, 0.6, r"(?:copying|distribution|reproduction|redistribution) is strictly prohibited"),
    ("proprietary", "secrets", 2, 0.6, r"contains (?:confidential information and )?trade secrets of"),
    ("eula", "agreement", 2, 0.6, r"end user licen[cs]e agreement"),
    ("noncommercial", "commercial|noncommercial", 2, 0.6, r"for (?:non ?commercial|academic and non ?commercial) use only"),
    ("personal-use", "personal", 2, 0.6, r"for (?:your )?personal use only"),
    ("research-only", "research", 2, 0.6, r"for (?:academic |non ?commercial )?research (?:purposes|use) only"),
    ("by-permission", "permission", 1, 0.4, r"(?:reprinted|reproduced|used) (?:with|by) (?:kind )?permission"),
)
PRIORITIES = 4


def rules() -> list[tuple[str, str, int, float, str]]:
    """(label, keywords, priority, confidence, pattern) in order: the texts, then each family by each way to name it."""
    out = list(TEXTS)
    for priority, confidence, way in WAYS:
        for label, keywords, name in FAMILIES:
            if priority > 1 or name[0] != "*":
                out.append((label, keywords, priority, confidence, way.replace("{}", f"(?:{name.lstrip('*')})")))
    return out


def normal(text: Column) -> Column:
    """The words of a text, lower-cased, each between single spaces; one space if it has none."""
    return F.regexp_replace(F.concat(F.lit(" "), lower_ascii(F.coalesce(text, F.lit(""))), F.lit(" ")), SEPARATORS, " ")


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def any_of(words: list[str]) -> str:
    """A pattern for any of some words, branching letter by letter: its cost hardly grows with their number."""
    by: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        if w:
            by.setdefault(w[0], []).append(w[1:])
    branches = [letter + (any_of(rest) if rest != [""] else "") for letter, rest in by.items()]
    out = branches[0] if len(branches) == 1 and "" not in words else f"(?:{'|'.join(branches)})"
    return f"{out}?" if "" in words else out


def _whole(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


def _places(words: Column, pattern: Column) -> Column:
    """(start, till), in characters, of every match of a pattern that matches no empty string."""
    sizes = F.zip_with(F.split(words, pattern, -1), F.regexp_extract_all(words, pattern, F.lit(0)), lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("n")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,till:int>>").alias("out"))
    step = lambda a, s: F.struct((a["at"] + s["gap"] + s["n"]).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + s["gap"]).alias("start"), (a["at"] + s["gap"] + s["n"]).alias("till")))).alias("out"))
    return F.aggregate(F.filter(sizes, lambda s: s["n"].isNotNull()), zero, step, lambda a: a["out"])


def _kept(found: Column) -> Column:
    """Labels and best confidence of the detections that no other contains.

    In order of start, longest and highest first, a detection is contained if an earlier one of its priority or a higher
    one reaches as far: the furthest reach of each priority is all that has to be kept, so one pass does.
    """
    reach = [f"r{p}" for p in range(1, PRIORITIES + 1)]
    zero = F.struct(*(F.lit(-1).alias(r) for r in reach), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"), F.lit(0).alias("n"))

    def step(a: Column, d: Column) -> Column:
        lost = F.lit(False)
        for p, r in enumerate(reach, 1):
            lost = lost | ((d["priority"] <= p) & (a[r] >= d["till"]))
        reached = [F.when(d["priority"] == p, F.greatest(a[r], d["till"])).otherwise(a[r]).alias(r) for p, r in enumerate(reach, 1)]
        return F.struct(*reached, F.when(lost, a["labels"]).otherwise(F.array_union(a["labels"], F.array(d["label"]))).alias("labels"), F.when(lost, a["score"]).otherwise(F.greatest(a["score"], d["confidence"])).alias("score"), F.when(lost, a["n"]).otherwise(a["n"] + 1).alias("n"))

    # A longer detection of lower priority is no shield, so of one start the order is by length, then priority, then rule.
    order = F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["till"]).alias("less"), (-d["priority"]).alias("low"), d["rule"].alias("rule"), d["till"].alias("till"), d["priority"].alias("priority"), d["label"].alias("label"), d["confidence"].alias("confidence")))
    return F.aggregate(F.array_sort(order), zero, step)


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, n_found, labels and score.

    score is the best confidence of a detection that stays, 1 where a base phrase stands. Null and empty texts have no
    words, no labels (empty strings) and score 0. Whole texts are searched, each row by itself: repeated rows are judged
    alike. Detections with equal bounds and priority: the first rule stays. Columns of these names are replaced, others
    pass through, empty tables stay empty.
    """
    listed = rules()
    known = F.array(*(F.struct(F.lit(i).alias("rule"), *(F.lit(v).alias(n) for v, n in zip((r[0], r[1].split("|"), *r[2:4]), ("label", "keywords", "priority", "confidence"), strict=True)), F.lit(_whole(r[4])).alias("pattern")) for i, r in enumerate(listed)))
    keywords = sorted({k for r in listed for k in r[1].split("|")})
    out = docs.withColumn("__words", normal(F.col(text)))
    gate = F.array_distinct(F.regexp_extract_all("__words", F.lit(_whole(any_of(keywords))), F.lit(0)))
    out = out.withColumn("__keys", gate).withColumn("__n", _spaces(F.col("__words")) - 1)
    # The base phrases.
    counted = []
    for i, (phrase, _) in enumerate(BASE):
        pieces = f"__base{i}"
        out = out.withColumn(pieces, F.when(F.contains(F.col("__words"), F.lit(f" {phrase} ")), F.split("__words", _whole(phrase), -1)))
        n = F.coalesce(F.size(pieces) - 1, F.lit(0))
        first = _spaces(F.get(pieces, F.lit(0))) - 1
        last = F.col("__n") - (_spaces(F.element_at(pieces, -1)) - 1) - len(phrase.split())
        counted.append((F.when(F.col(pieces).isNotNull(), n).otherwise(0), first, last, F.col(pieces).isNotNull()))
    base = F.concat_ws(",", F.array_sort(F.array_compact(F.array(*(F.when(c[3], F.lit(label)) for c, (_, label) in zip(counted, BASE, strict=True))))))
    least, most = F.least(*(c[1] for c in counted)), F.greatest(*(c[2] for c in counted))
    out = out.withColumns({"n_words": F.col("__n").cast("bigint"), "n_base": sum((c[0] for c in counted), F.lit(0)).cast("bigint"), "first_word": least.cast("bigint"), "last_word": most.cast("bigint"), "base_labels": base})
    # The rules whose keywords stand in the text.
    out = out.withColumn("__tried", F.when(F.size("__keys") > 0, F.filter(known, lambda r: F.arrays_overlap("__keys", r["keywords"]))))
    hits = F.flatten(F.transform("__tried", lambda r: F.transform(_places(F.col("__words"), r["pattern"]), lambda p: F.struct(p["start"].alias("start"), p["till"].alias("till"), r["rule"].alias("rule"), r["label"].alias("label"), r["priority"].alias("priority"), r["confidence"].alias("confidence")))))
    out = out.withColumn("__hits", F.when(F.size("__tried") > 0, hits))
    out = out.withColumn("__kept", F.when(F.size("__hits") > 0, _kept(F.col("__hits"))))
    mine = F.coalesce(F.col("__kept.labels"), F.array().cast("array<string>"))
    theirs = F.filter(F.split("base_labels", ","), lambda x: x != "")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.col("__kept.score"), F.lit(0.0)))
    out = out.withColumns({"labels": F.array_join(F.array_sort(F.array_union(mine, theirs)), ","), "n_found": F.coalesce(F.col("__kept.n"), F.lit(0)).cast("bigint"), "score": score})
    return out.drop("__words", "__keys", "__n", "__tried", "__hits", "__kept", *(f"__base{i}" for i in range(len(BASE))))


def query(spark, sf_dir: str) -> DataFrame:
    from quillmill.llm.common import read

    return scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "n_found", "score")
