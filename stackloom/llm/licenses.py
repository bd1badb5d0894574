"""License scan: ordered signature rules behind a keyword prefilter.

Each license family contributes rules for its SPDX tag, grant sentence, name and address; further rules are sentences
written for the text of one license each. A rule runs on a text only if its keywords all occur there: one automaton finds
the longest keyword of every rule in all texts of a block, and only then the rule's others are looked for. Keywords are
read off the rule's own pattern: stretches of literal letters that every match holds, so a text without them can't match,
however it is wrapped, hyphenated or spelt. Overlapping detections are settled by priority, then length, then position: a
detection that lies within the interval of an accepted one is suppressed.

Besides the rules, the base phrases are located word by word. Defined cases: a null text counts as empty and has no
detection (score 0); very long texts are scanned whole, in time that grows with n log n of the detections; repeated rows
are scanned one by one; an empty table gives no rows; other columns are not read, and one that is
kept under the name of a result column is returned as <name>_kept.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as sre
from re import _parser

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columnar import WORD_BY_ALNUM, Texts, Words, slices
from .schema import carried, named, with_fields

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Hand-written families: label; words to find it by (for the reader); SPDX identifier; name; address. A dash leaves a rule out. S stands
# for white space or hyphens, with comment marks at line ends and starts, V for an optional "version" word; patterns and texts are in lower case.
FAMILIES = r"""
gpl-1.0 | general public | gpl-1\.0(?:-only|-or-later|\+)? | gnuSgeneralSpublicSlicen[cs]e,?SV1(?:\.0)?\b | gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0
gpl-2.0 | general public | gpl-2\.0(?:-only|-or-later|\+)? | gnuSgeneralSpublicSlicen[cs]e,?SV2(?:\.0)?\b | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl-3.0 | general public | gpl-3\.0(?:-only|-or-later|\+)? | gnuSgeneralSpublicSlicen[cs]e,?SV3(?:\.0)?\b | gnu\.org/licenses/gpl-3\.0
gpl | general public | gpl | gnuSgeneralSpublicSlicen[cs]e | gnu\.org/licenses/gpl
lgpl-2.0 | lesser | lgpl-2\.0(?:-only|-or-later|\+)? | gnuS(?:library|lesser)SgeneralSpublicSlicen[cs]e,?SV2(?:\.0)?\b | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0
lgpl-2.1 | lesser | lgpl-2\.1(?:-only|-or-later|\+)? | gnuSlesserSgeneralSpublicSlicen[cs]e,?SV2\.1\b | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
lgpl-3.0 | lesser | lgpl-3\.0(?:-only|-or-later|\+)? | gnuSlesserSgeneralSpublicSlicen[cs]e,?SV3(?:\.0)?\b | gnu\.org/licenses/lgpl-3\.0
lgpl | lesser | lgpl | gnuS(?:library|lesser)SgeneralSpublicSlicen[cs]e | gnu\.org/licenses/lgpl
agpl-3.0 | affero | agpl-3\.0(?:-only|-or-later|\+)? | gnuSafferoSgeneralSpublicSlicen[cs]e(?:,?SV3(?:\.0)?)?\b | gnu\.org/licenses/agpl
gfdl-1.3 | free documentation | gfdl-1\.3(?:-only|-or-later)? | gnuSfreeSdocumentationSlicen[cs]e,?SV1\.3\b | gnu\.org/licenses/fdl-1\.3
gfdl | free documentation | gfdl | gnuSfreeSdocumentationSlicen[cs]e | gnu\.org/licenses/fdl
apache-1.1 | apache | apache-1\.1 | apacheS(?:software)?S?licen[cs]e,?SV1\.1\b | apache\.org/licenses/license-1\.1
apache-2.0 | apache | apache-2\.0 | apacheS(?:software)?S?licen[cs]e,?SV2(?:\.0)?\b | apache\.org/licenses/license-2\.0
apache | apache | apache | apacheS(?:softwareS)?licen[cs]e | apache\.org/licenses
mit-0 | attribution | mit-0 | mitSnoSattribution(?:Slicen[cs]e)? | opensource\.org/licenses?/mit-0
mit | mit | mit | (?:theS)?mitSlicen[cs]e | opensource\.org/licenses?/mit\b
x11 | x11 | x11 | x11Slicen[cs]e | -
expat | expat | expat | expatSlicen[cs]e | -
bsd-0-clause | bsd | 0bsd | (?:zero|0)SclauseSbsdSlicen[cs]e | opensource\.org/licenses?/0bsd
bsd-2-clause | bsd | bsd-2-clause(?:-patent|-views)? | (?:(?:simplified|freebsd)Sbsd|bsdS(?:2|two)Sclause|(?:2|two)SclauseSbsd)Slicen[cs]e | opensource\.org/licenses?/bsd-2-clause
bsd-3-clause | bsd | bsd-3-clause(?:-clear|-lbnl)? | (?:(?:new|revised|modified)Sbsd|bsdS(?:3|three)Sclause|(?:3|three)SclauseSbsd)Slicen[cs]e | opensource\.org/licenses?/bsd-3-clause
bsd-4-clause | bsd | bsd-4-clause(?:-uc)? | (?:originalSbsd|bsdS(?:4|four)Sclause|(?:4|four)SclauseSbsd)Slicen[cs]e | -
bsd | bsd | bsd | bsdSlicen[cs]e | opensource\.org/licenses?/bsd-license
isc | isc | isc | iscSlicen[cs]e | opensource\.org/licenses?/isc
mpl-1.1 | mozilla | mpl-1\.1 | mozillaSpublicSlicen[cs]e,?SV1\.1\b | mozilla\.org/mpl/1\.1
mpl-2.0 | mozilla | mpl-2\.0 | mozillaSpublicSlicen[cs]e,?SV2(?:\.0)?\b | mozilla\.org/(?:en-us/)?mpl/2\.0
mpl | mozilla | mpl | mozillaSpublicSlicen[cs]e | mozilla\.org/(?:en-us/)?mpl
epl-1.0 | eclipse | epl-1\.0 | eclipseSpublicSlicen[cs]e,?S(?:-S)?V1(?:\.0)?\b | eclipse\.org/legal/epl-v10
epl-2.0 | eclipse | epl-2\.0 | eclipseSpublicSlicen[cs]e,?S(?:-S)?V2(?:\.0)?\b | eclipse\.org/legal/epl-2\.0
edl-1.0 | eclipse | - | eclipseSdistributionSlicen[cs]e | eclipse\.org/org/documents/edl-v10
cddl-1.0 | common development | cddl-1\.[01] | commonSdevelopmentSandSdistributionSlicen[cs]e | opensource\.org/licenses?/cddl
cpl-1.0 | common public | cpl-1\.0 | commonSpublicSlicen[cs]e(?:,?SV1\.0)? | opensource\.org/licenses?/cpl
eupl-1.1 | european union public | eupl-1\.1 | europeanSunionSpublicSlicen[cs]e,?SV1\.1\b | -
eupl-1.2 | european union public | eupl-1\.2 | europeanSunionSpublicSlicen[cs]e(?:,?SV1\.2)? | joinup\.ec\.europa\.eu/[a-z/]*eupl
artistic-1.0 | artistic | artistic-1\.0 | artisticSlicen[cs]e,?SV1(?:\.0)?\b | -
artistic-2.0 | artistic | artistic-2\.0 | artisticSlicen[cs]e(?:,?SV2(?:\.0)?)? | opensource\.org/licenses?/artistic-license-2\.0
bsl-1.0 | boost | bsl-1\.0 | boostSsoftwareSlicen[cs]e(?:S?-?SV1\.0)? | boost\.org/license_1_0
busl-1.1 | business source | busl-1\.1 | businessSsourceSlicen[cs]e(?:,?SV?1\.1)? | mariadb\.com/bsl11
sspl-1.0 | server side | sspl-1\.0 | serverSsideSpublicSlicen[cs]e | mongodb\.com/licensing/server-side-public-license
elastic-2.0 | elastic | elastic-2\.0 | elasticSlicen[cs]e(?:,?SV?2(?:\.0)?)? | elastic\.co/licensing/elastic-license
unlicense | unlicense | unlicense | (?:the)?S?unlicense\b | unlicense\.org
wtfpl | wtfpl | wtfpl | doSwhatStheSfuckSyouSwantStoSpublicSlicen[cs]e | wtfpl\.net
zlib | zlib | zlib | zlib(?:/libpng)?Slicen[cs]e | zlib\.net/zlib_license
libpng | libpng | libpng(?:-2\.0)? | libpngSlicen[cs]e | -
openssl | openssl | openssl | opensslSlicen[cs]e | -
python-2.0 | python | psf-2\.0|python-2\.0 | pythonSsoftwareSfoundationSlicen[cs]e(?:SV2)? | docs\.python\.org/[0-9./]*license
php-3.01 | php | php-3\.0?1? | phpSlicen[cs]e(?:,?SV3(?:\.0?1?)?)? | php\.net/license
ruby | ruby | ruby | rubySlicen[cs]e | -
postgresql | postgresql | postgresql | postgresqlSlicen[cs]e | postgresql\.org/about/licen[cs]e
ncsa | ncsa | ncsa | (?:universitySofSillinois/)?ncsaSopenSsourceSlicen[cs]e | -
w3c | w3c | w3c(?:-20150513)? | w3cSsoftware(?:SnoticeSand)?S(?:documentS)?licen[cs]e | w3\.org/consortium/legal/[a-z0-9/-]*copyright
ofl-1.1 | open font | ofl-1\.[01](?:-rfn)? | (?:silS)?openSfontSlicen[cs]e(?:,?SV1\.1)? | scripts\.sil\.org/ofl
odbl-1.0 | open database | odbl-1\.0 | openSdatabaseSlicen[cs]e | opendatacommons\.org/licenses/odbl
odc-by-1.0 | data commons | odc-by-1\.0 | openSdataScommonsSattributionSlicen[cs]e | opendatacommons\.org/licenses/by
pddl-1.0 | public domain dedication | pddl-1\.0 | publicSdomainSdedicationSandSlicen[cs]e | opendatacommons\.org/licenses/pddl
cc0-1.0 | cc0 | cc0-1\.0 | cc0(?:S1\.0)?(?:Suniversal)? | creativecommons\.org/publicdomain/zero
cc-by-nc-nd | cc;creative commons | cc-by-nc-nd-[1-4]\.[05] | (?:ccSbySncSnd|creativeScommonsSattributionSnon-?commercialSno-?deriv(?:s|atives|ativeSworks)) | creativecommons\.org/licenses/by-nc-nd
cc-by-nc-sa | cc;creative commons | cc-by-nc-sa-[1-4]\.[05] | (?:ccSbySncSsa|creativeScommonsSattributionSnon-?commercialSshare-?Salike) | creativecommons\.org/licenses/by-nc-sa
cc-by-nc | cc;creative commons | cc-by-nc-[1-4]\.[05] | (?:ccSbySnc|creativeScommonsSattributionSnon-?commercial) | creativecommons\.org/licenses/by-nc/
cc-by-nd | cc;creative commons | cc-by-nd-[1-4]\.[05] | (?:ccSbySnd|creativeScommonsSattributionSno-?deriv(?:s|atives|ativeSworks)) | creativecommons\.org/licenses/by-nd
cc-by-sa | cc;creative commons | cc-by-sa-[1-4]\.[05] | (?:ccSbySsa|creativeScommonsSattributionSshare-?Salike) | creativecommons\.org/licenses/by-sa
cc-by | cc;creative commons | cc-by-[1-4]\.[05] | (?:ccSbyS[1-4]\.[05]|creativeScommonsSattribution) | creativecommons\.org/licenses/by/
ms-pl | microsoft | ms-pl | microsoftSpublicSlicen[cs]e | opensource\.org/licenses?/ms-pl
ms-rl | microsoft | ms-rl | microsoftSreciprocalSlicen[cs]e | opensource\.org/licenses?/ms-rl
osl-3.0 | open software license | osl-[123]\.[01] | openSsoftwareSlicen[cs]e(?:,?SV3\.0)? | -
afl-3.0 | academic free | afl-[123]\.[0-2] | academicSfreeSlicen[cs]e(?:,?SV3\.0)? | -
qpl-1.0 | q public | qpl-1\.0 | qSpublicSlicen[cs]e | -
upl-1.0 | universal permissive | upl-1\.0 | universalSpermissiveSlicen[cs]e | oss\.oracle\.com/licenses/upl
vim | vim | vim | vimSlicen[cs]e | -
lppl-1.3c | latex | lppl-1\.3[ac]? | latexSprojectSpublicSlicen[cs]e | latex-project\.org/lppl
cecill-2.1 | cecill | cecill-2\.[01]|cecill-[bc] | cecill(?:-[bc])?(?:Sfree)?(?:Ssoftware)?Slicen[cs]e | cecill\.info/licences
mulan-psl-2.0 | mulan | mulanpsl-2\.0 | mulanSpermissiveSsoftwareSlicen[cs]e | license\.coscl\.org\.cn/mulanpsl2
openrail | responsible ai | - | (?:openSresponsibleSaiSlicen[cs]e|(?:bigscience|creativeml)SopenSrail(?:-m)?) | -
"""

# Hand-written single rules: label | words to find it by (for the reader) | pattern | priority.
SINGLE = r"""
gpl-2.0 | either version 2 | eitherSversionS2SofStheSlicen[cs]e | 70
gpl-3.0 | either version 3 | eitherSversionS3SofStheSlicen[cs]e | 70
gpl | gplv | \bgplv?S?[123](?:\.0)?\+? | 55
lgpl | lgplv | \blgplv?S?[23](?:\.[01])?\+? | 56
agpl-3.0 | agplv | \bagplv?S?3(?:\.0)?\+? | 57
mit | permission is hereby granted | permissionSisSherebySgranted,SfreeSofScharge,StoSanySpersonSobtainingSaScopy | 75
bsd | redistribution and use | redistributionSandSuseSinSsourceSandSbinarySforms | 65
bsd-3-clause | endorse or promote | beSusedStoSendorseSorSpromoteSproducts | 66
isc | permission to use, copy | permissionStoSuse,Scopy,Smodify,?Sand(?:/or)?SdistributeSthisSsoftware | 64
zlib | altered source | alteredSsourceSversionsSmustSbeSplainlySmarked | 64
apache-2.0 | you may not use this file | youSmaySnotSuseSthisSfileSexceptSinScomplianceSwithStheSlicen[cs]e | 74
unlicense | free and unencumbered | freeSandSunencumberedSsoftwareSreleasedSintoStheSpublicSdomain | 75
public-domain | public domain | (?:released|placed|dedicated)S(?:intoS|inS|toS)?(?:theS)?publicSdomain | 50
public-domain | public domain | \bpublicSdomain\b | 30
proprietary | all rights reserved | allSrightsSreserved | 20
proprietary | confidential | (?:proprietarySandSconfidential|confidentialSandSproprietary) | 40
proprietary | redistribution | (?:unauthori[sz]edS(?:copying|redistribution)|redistributionS(?:isS)?(?:not|strictly)S(?:permitted|prohibited)) | 40
commercial | end user license | endSuserSlicen[cs]eSagreement | 35
trial | evaluation | forSevaluationS(?:purposesS)?only | 35
"""

# Hand-written sentences, each of one license's text: label | pattern.
SENTENCES = r"""
gpl | thisSprogramSisSfreeSsoftware
gpl | redistributeSitSand/orSmodifySitSunderStheStermsSofStheSgnuSgeneral
gpl | asSpublishedSbyStheSfreeSsoftwareSfoundation
gpl | withoutSevenStheSimpliedSwarrantySofSmerchantability
gpl | youSshouldShaveSreceivedSaScopySofStheSgnuSgeneralSpublicSlicen[cs]e
gpl | theSlicen[cs]esSforSmostSsoftwareS(?:andSotherSpracticalSworksS)?areSdesignedStoStakeSawaySyourSfreedom
gpl-1.0 | thisSlicen[cs]eSagreementSappliesStoSanySprogramSorSotherSworkSwhich
gpl-2.0 | thisSlicen[cs]eSappliesStoSanySprogramSorSotherSworkSwhichScontainsSaSnotice
gpl-2.0 | mereSaggregationSofSanotherSworkSnotSbasedSonStheSprogram
gpl-3.0 | gnuSgeneralSpublicSlicen[cs]eSisSaSfree,ScopyleftSlicen[cs]e
gpl-3.0 | protectingSusers.{0,3}SlegalSrightsSfromSanti-circumventionSlaw
gpl-3.0 | basicSpermissions\.S?allSrightsSgrantedSunderSthisSlicen[cs]eSareSgrantedSforStheSterm
lgpl | thisSlibrarySisSfreeSsoftware
lgpl | youSshouldShaveSreceivedSaScopySofStheSgnuS(?:lesser|library)SgeneralSpublicSlicen[cs]e
lgpl-2.1 | workSthatSusesStheSlibrary
lgpl-3.0 | incorporatesStheStermsSandSconditionsSofSversionS3SofStheSgnuSgeneralSpublicSlicen[cs]e
agpl-3.0 | remoteSnetworkSinteraction
agpl-3.0 | ensureScooperationSwithStheScommunitySinStheScaseSofSnetworkSserverSsoftware
gfdl | permissionSisSgrantedStoScopy,SdistributeSand/orSmodifySthisSdocument
gfdl | withSnoSinvariantSsections
classpath-exception-2.0 | classpathSexception
gpl-linking-exception | linkingSthisSlibrarySstaticallySorSdynamicallySwithSotherSmodules
gcc-exception-3.1 | gccSruntimeSlibrarySexception
openssl-exception | permissionStoSlinkS(?:theScodeSof)?.{0,60}?SwithStheSopensslSlibrary
bison-exception-2.2 | createSaSlargerSworkSthatScontainsSpartSorSallSofStheSbisonSparserSskeleton
font-exception-2.0 | embedsSthisSfontSorSunalteredSportionsSofSthisSfont
license-text | everyoneSisSpermittedStoScopySandSdistributeSverbatimScopies
apache-1.1 | thisSproductSincludesSsoftwareSdevelopedSbyStheSapacheSsoftwareSfoundation
apache-1.1 | productsSderivedSfromSthisSsoftwareSmaySnotSbeScalledS.{0,3}apache
apache-2.0 | unlessSrequiredSbySapplicableSlawSorSagreedStoSinSwriting
apache-2.0 | seeStheSlicen[cs]eSforStheSspecificSlanguageSgoverningSpermissions
apache-2.0 | perpetual,Sworldwide,Snon-exclusive,Sno-charge,Sroyalty-free,Sirrevocable
mit | theSaboveScopyrightSnoticeSandSthisSpermissionSnoticeSshallSbeSincludedSinSall
mit | theSsoftwareSisSprovidedS.{0,3}asSis.{1,4}?withoutSwarrantySofSanySkind
mit | inSnoSeventSshallStheSauthorsSorScopyrightSholdersSbeSliable
mit | toSdealSinStheSsoftwareSwithoutSrestriction
x11 | theSxSconsortiumSshallSnotSbeSusedSinSadvertising
curl | danielSstenberg.{0,60}?allSrightsSreserved
curl | exceptSasScontainedSinSthisSnotice,StheSnameSofSaScopyrightSholderSshallSnot
hpnd | permissionStoSuse,Scopy,Smodify,SandSdistributeSthisSsoftwareSandSitsSdocumentation
hpnd | makesSnoSrepresentationsSaboutStheSsuitabilitySofSthisSsoftware
mit-cmu | carnegieSmellonSuniversitySdisclaimsSallSwarranties
ntp | universitySofSdelawareSmakesSnoSrepresentations
isc | theSauthorSdisclaimsSallSwarrantiesSwithSregardStoSthisSsoftware
isc | aboveScopyrightSnoticeSandSthisSpermissionSnoticeSappearSinSallScopies
bsd-2-clause | redistributionsSofSsourceScodeSmustSretainStheSaboveScopyright
bsd-2-clause | redistributionsSinSbinarySformSmustSreproduceStheSaboveScopyright
bsd-2-clause-views | theSviewsSandSconclusionsScontainedSinStheSsoftwareSandSdocumentation
bsd-2-clause-patent | eachScopyrightSholderSandScontributorSherebySgrantsStoSthoseSreceivingSrights
bsd-3-clause | neitherStheSnames?SofS.{1,90}?SnorStheSnamesSofSitsScontributors
bsd-3-clause-clear | noSexpressSorSimpliedSlicen[cs]esStoSanySparty.{0,3}sSpatentSrights
bsd-3-clause-no-nuclear | notSdesigned,Slicen[cs]edSorSintendedSforSuseSinStheSdesign,Sconstruction,SoperationSorSmaintenanceSofSanySnuclearSfacility
bsd-4-clause | allSadvertisingSmaterialsSmentioningSfeaturesSorSuseSofSthisSsoftware
bsd | thisSsoftwareSisSprovidedSbyStheScopyrightSholdersSandScontributors
bsd | thisSsoftwareSisSprovidedSbyStheSregentsSandScontributors
bsd-source-code | redistributionSofSsourceScodeSmustSretainSthisSnotice
mpl-1.1 | theScontentsSofSthisSfileSareSsubjectStoStheSmozillaSpublic
mpl-1.1 | theSinitialSdeveloperSofStheSoriginalScode
mpl-2.0 | thisSsourceScodeSformSisSsubjectStoStheStermsSofStheSmozillaSpublic
mpl-2.0 | ifSaScopySofStheSmplSwasSnotSdistributedSwithSthisSfile
mpl-2.0-no-copyleft-exception | incompatibleSwithSsecondarySlicen[cs]es
npl-1.1 | netscapeSpublicSlicen[cs]e
epl-1.0 | accompanyingSprogramSisSprovidedSunderStheStermsSofSthisSeclipse
epl-2.0 | accompanyingSmaterialsSareSmadeSavailableSunderStheStermsSofStheSeclipse
cddl-1.0 | subjectStoStheStermsSofStheScommonSdevelopmentSandSdistribution
cpl-1.0 | accompanyingSprogramSisSprovidedSunderStheStermsSofSthisScommonSpublic
ipl-1.0 | ibmSpublicSlicen[cs]e
eupl | licen[cs]edSunderStheSeupl
artistic-1.0 | theSintentSofSthisSdocumentSisStoSstateStheSconditionsSunderSwhich
artistic-2.0 | theScopyrightSholderSintendsSthatStheSpackageSbeSkeptSfree
perl-5 | underStheSsameStermsSasSperlSitself
bsl-1.0 | freeSofScharge,StoSanySpersonSorSorganizationSobtainingSaScopySofStheSsoftware
zlib | theSoriginSofSthisSsoftwareSmustSnotSbeSmisrepresented
zlib | thisSnoticeSmaySnotSbeSremovedSorSalteredSfromSanySsource
zlib | permissionSisSgrantedStoSanyoneStoSuseSthisSsoftwareSforSanySpurpose
libpng | theSpngSreferenceSlibrarySisSsupplied
openssl | softwareSdevelopedSbyStheSopensslSproject
ssleay | cryptographicSsoftwareSwrittenSbySericSyoung
python-2.0 | psfSisSmakingSpythonSavailableStoSlicensee
python-2.0 | agreementSisSbetweenStheSpythonSsoftwareSfoundation
cnri-python | cnriSgrantsSlicenseeSaSnonexclusive
beopen-python | beopenSpythonSopenSsourceSlicen[cs]e
php-3.01 | thisSproductSincludesSphpSsoftware
zend-2.0 | zendSengineSlicen[cs]e
ruby | giveSawaySverbatimScopiesSofStheSsourceSformSofStheSsoftware
tcl | theSfollowingStermsSapplyStoSallSfilesSassociatedSwithStheSsoftware
postgresql | inSnoSeventSshallStheSuniversitySofScaliforniaSbeSliable
ncsa | theSnamesSofS.{1,90}?SnorStheSnamesSofSitsScontributorsSmaySbeSusedStoSendorse
w3c | w3cSsoftwareSnoticeSandSlicen[cs]e
w3c | byS(?:obtaining,S)?usingSand/orScopyingSthisSwork
ofl-1.1 | theSfontSsoftwareSmaySbeSmodified,SalteredSorSaddedSto
ofl-1.1 | withSreservedSfontSname
ubuntu-font-1.0 | ubuntuSfontSlicen[cs]e
bitstream-vera | bitstreamSveraSfontsScopyright
cc0-1.0 | dedicatedStheSworkStoStheSpublicSdomainSbySwaivingSall
cc0-1.0 | affirmerSherebySovertly,Sfully,Spermanently,Sirrevocably
cc-by | youSmustSgiveSappropriateScredit,SprovideSaSlinkStoStheSlicen[cs]e
cc-by-sa | youSmustSdistributeSyourScontributionsSunderStheSsameSlicen[cs]e
cc-by-nc | youSmaySnotSuseStheSmaterialSforScommercialSpurposes
cc-by-nd | youSmaySnotSdistributeStheSmodifiedSmaterial
cc-sampling-plus | creativeScommonsSsampling
cc-devnations | creativeScommonsSdevelopingSnations
odbl-1.0 | anySuseSofStheSdatabaseSmustSbeSaccompaniedSbyS.{0,30}?open
odc-by-1.0 | odcSattributionSlicen[cs]e
cdla | communitySdataSlicen[cs]eSagreement
ogl-uk | openSgovernmentSlicen[cs]e
etalab-2.0 | licen[cs]eSouverte
dl-de-by-2.0 | datenlizenzSdeutschland
nlod | norwegianSlicen[cs]eSforSopenSgovernmentSdata
iodl-2.0 | italianSopenSdataSlicen[cs]e
ms-pl | thisSlicen[cs]eSgovernsSuseSofStheSaccompanyingSsoftware
ms-rl | forSanySfileSyouSdistributeSthatScontainsScodeSfromStheSsoftware
ms-lpl | microsoftSlimitedSpublicSlicen[cs]e
ms-eula | microsoftSsoftwareSlicen[cs]eSterms
osl | licen[cs]edSunderStheSopenSsoftwareSlicen[cs]e
afl | licen[cs]edSunderStheSacademicSfreeSlicen[cs]e
rpl-1.5 | reciprocalSpublicSlicen[cs]e
sissl | sunSindustrySstandardsSsourceSlicen[cs]e
spl-1.0 | sunSpublicSlicen[cs]e
apsl | appleSpublicSsourceSlicen[cs]e
aladdin | aladdinSfreeSpublicSlicen[cs]e
catosl-1.1 | computerSassociatesStrustedSopenSsourceSlicen[cs]e
cua-opl-1.0 | cuaSofficeSpublicSlicen[cs]e
ecl | educationalScommunitySlicen[cs]e
efl | eiffelSforumSlicen[cs]e
entessa | entessaSpublicSlicen[cs]e
eudatagrid | euSdatagridSsoftwareSlicen[cs]e
fair | usageSofStheSworksSisSpermittedSprovidedSthatSthisSinstrumentSisSretained
frameworx-1.0 | frameworxSopenSlicen[cs]e
intel | intelSopenSsourceSlicen[cs]e
liliq | licen[cs]eSlibreSduSqu.{1,2}bec
lpl-1.02 | lucentSpublicSlicen[cs]e
miros | mirosSlicen[cs]e
motosoto | motosotoSopenSsourceSlicen[cs]e
multics | multicsSlicen[cs]e
nasa-1.3 | nasaSopenSsourceSagreement
naumen | naumenSpublicSlicen[cs]e
nokia | nokiaSopenSsourceSlicen[cs]e
nposl-3.0 | non-?profitSopenSsoftwareSlicen[cs]e
oclc-2.0 | oclcSresearchSpublicSlicen[cs]e
ogtsl | openSgroupStestSsuiteSlicen[cs]e
oldap-2.8 | openldapSpublicSlicen[cs]e
oset-pl-2.1 | osetS(?:foundationS)?publicSlicen[cs]e
rpsl-1.0 | realnetworksSpublicSsourceSlicen[cs]e
rscpl | ricohSsourceScodeSpublicSlicen[cs]e
simpl-2.0 | simpleSpublicSlicen[cs]e
sleepycat | sleepycatSlicen[cs]e
sleepycat | accompaniedSbySinformationSonShowStoSobtainScompleteSsourceScode
vsl-1.0 | vovidaSsoftwareSlicen[cs]e
watcom-1.0 | openSwatcomSpublicSlicen[cs]e
wxwindows | wxwindowsSlibrarySlicen[cs]e
xnet | x\.netSlicen[cs]e
ypl-1.1 | yahoo!?SpublicSlicen[cs]e
zpl | zopeSpublicSlicen[cs]e
nethack | nethackSgeneralSpublicSlicen[cs]e
json | shallSbeSusedSforSgood,SnotSevil
beerware | beer[\s-]?wareSlicen[cs]e
beerware | buySmeSaSbeerSinSreturn
wtfpl | youSjustSdoSwhatStheSfuckSyouSwantSto
unlicense | anyoneSisSfreeStoScopy,Smodify,Spublish,Suse,Scompile,Ssell
blueoak-1.0.0 | blueSoakSmodelSlicen[cs]e
busl-1.1 | additionalSuseSgrant
sspl-1.0 | offeringStheSprogramSasSaSservice
elastic-2.0 | provideStheSsoftwareStoSthirdSpartiesSasSaShostedSorSmanagedSservice
commons-clause | commonsSclause
prosperity-3.0 | prosperitySpublicSlicen[cs]e
parity-7.0 | paritySpublicSlicen[cs]e
polyform | polyformS(?:noncommercial|smallSbusiness|perimeter|shield|strict|internalSuse|freeStrial)
hippocratic | hippocraticSlicen[cs]e
anti-996 | anti-?S?996Slicen[cs]e
fsl | functionalSsourceSlicen[cs]e
confluent | confluentScommunitySlicen[cs]e
redis-sal | redisSsourceSavailableSlicen[cs]e
timescale | timescaleSlicen[cs]e
llama | llamaS(?:[0-9.]+S)?communitySlicen[cs]e
gemma | gemmaStermsSofSuse
openrail | use-?basedSrestrictionsSasSreferencedSin
apple-sample | appleSgrantsSyouSaSpersonal,Snon-?exclusiveSlicen[cs]e
amazon | amazonSsoftwareSlicen[cs]e
nvidia | nvidiaSsoftwareSlicen[cs]eSagreement
oracle-bcl | oracleSbinaryScodeSlicen[cs]e
oracle-nftc | oracleSno-feeStermsSandSconditions
sun-bcl | sunSmicrosystems,?Sinc\.?SbinaryScodeSlicen[cs]e
intel-simplified | intelSsimplifiedSsoftwareSlicen[cs]e
android-sdk | androidSsoftwareSdevelopmentSkitSlicen[cs]e
unicode-dfs | unicodeSdataSfilesSandSsoftware
unicode | unicode,?S(?:inc\.?S)?licen[cs]eSagreement
icu | icuSlicen[cs]e
info-zip | info-zipSlicen[cs]e
bzip2 | bzip2SandSlibbzip2
ftl | freetypeSprojectSlicen[cs]e
ijg | softwareSisSbasedSinSpartSonStheSworkSofStheSindependentSjpegSgroup
libtiff | samSlefflerSandSsiliconSgraphics
sgi-b-2.0 | sgiSfreeSsoftwareSlicen[cs]e
hdf5 | hdf5S\(hierarchicalSdataSformat
latex2e | permissionSisSgrantedStoScopySandSdistributeSmodifiedSversionsSofSthisSmanual
lppl | distributedSand/orSmodifiedSunderStheSconditionsSofStheSlatex
cecill | contratSdeSlicen[cs]eSdeSlogicielSlibre
mulan-psl-2.0 | mulanSpslSv2
d-fsl-1.0 | deutscheSfreieSsoftwareSlizenz
vim | vimSisScharityware
us-government | workSofStheSunitedSstatesSgovernment
public-domain | noScopyrightS(?:isS)?(?:claimed|reserved)
public-domain | disclaimsScopyrightStoSthisSsourceScode
proprietary | proprietarySinformationSof
proprietary | tradeSsecretsSof
proprietary | notSbeS(?:reproduced|copied|disclosed),?SinSwholeSorSinSpart
proprietary | priorSwrittenS(?:consent|permission)SofStheS(?:copyrightS(?:owner|holder)|publisher|author)
commercial | thisSisSaSlegalSagreementSbetweenSyou
commercial | byS(?:installing|downloading|using)StheSsoftware,?SyouSagreeStoSbeSbound
commercial | subscriptionSlicen[cs]eSagreement
freeware | (?:program|software)SisSfreeware
shareware | (?:program|software)SisSshareware
non-commercial | forSnon-?commercialS(?:use|purposes)Sonly
academic | forS(?:academic|research)S(?:useS|purposesS)?only
dual-license | dual[\s-]?licen[cs]edSunder
license-reference | licen[cs]eSinformationScanSbeSfoundSinStheSlicen[cs]eSfile
license-reference | useSofSthisSsourceScodeSisSgovernedSbySa
"""
#: Priority of a sentence, above names and below tags, addresses and grants.
SENTENCE = 72


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[frozenset[bytes], ...]  # alternatives, each of keywords that must all occur
    pattern: re.Pattern
    priority: int
    weight: float


#: White space or hyphens, and marks of comments (`# `, ` * `, `// `) around them.
_SPACE = r"[\s-]+(?:[#*/;%!>|]{1,3}[\s-]+)*"


def _pattern(text: str) -> re.Pattern:
    return re.compile(text.replace("SV", rf"(?:{_SPACE}v(?:ersion|\.)?)?[\s-]*").replace("S", f"(?:{_SPACE})").encode())



#: Alternatives of keywords a rule has at most; keywords of each, and letters of them in all from which on no more are taken.
_ALTERNATIVES, _KEYWORDS, _LETTERS = 24, 5, 14


def _literals(items: Iterable, before: bytes = b"") -> list[frozenset[bytes]]:
    """For a parsed pattern: sets of literals, one of which is found as a whole in every match. before: what leads up to it."""
    out, run = [frozenset()], bytearray(before)

    def also(choices: list[frozenset[bytes]]) -> None:
        nonlocal out
        both = list(dict.fromkeys(a | b for a in out for b in choices))
        out = both if len(both) <= _ALTERNATIVES else out

    def cut() -> None:
        if run:
            also([frozenset([bytes(run)])])
            run.clear()

    for op, arg in items:
        if op is sre.LITERAL:
            run.append(arg)
            continue
        lead = bytes(run)
        cut()
        if op is sre.SUBPATTERN:
            also(_literals(arg[-1], lead))
        elif op is sre.BRANCH:
            also(list(dict.fromkeys(x for branch in arg[1] for x in _literals(branch, lead))))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
            also(_literals(arg[2]))
    cut()
    return out


def keywords_of(pattern: re.Pattern) -> tuple[frozenset[bytes], ...]:
    """Alternatives of the longest literals; each text with a match holds all keywords of one of them."""
    out = []
    for found in _literals(_parser.parse(pattern.pattern)):
        best = sorted((k for k in found if not any(k != x and k in x for x in found)), key=lambda k: (-len(k), k))
        best = [k for k in best if len(k) > 2] or best
        enough = next((n for n in range(2, _KEYWORDS) if sum(map(len, best[:n])) >= _LETTERS), _KEYWORDS)
        out.append(frozenset(best[:enough]))
    return tuple(a for a in dict.fromkeys(out) if not any(b < a for b in out))


def _rule(label: str, pattern: re.Pattern, priority: int, weight: float) -> Rule:
    return Rule(label, keywords_of(pattern), pattern, priority, weight)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, the most specific first."""
    out = []
    for line in FAMILIES.strip().splitlines():
        label, _, spdx, name, url = re.split(r" \| ", line.strip())
        specific = 2 * bool(re.search(r"\d", label)) + (label.count("-") > 1)
        if spdx != "-":
            out.append(_rule(label, re.compile(rf"spdx-license-identifier:\s*(?:[\w.+() -]*\b(?:or|and)\s+)?\(?(?P<id>{spdx})(?![\w.+-])".encode()), 95 + specific, 1.0))
            out.append(_rule(label, re.compile(rf"licen[cs]e\s*[:=]\s*[\"']?(?:{spdx})(?![\w.+-])".encode()), 60 + specific, 0.9))
        if name != "-":
            out.append(_rule(label, _pattern(rf"(?:licen[cs]ed|released|distributed|available|published)S(?:underS)(?:theS)?(?:termsSofStheS)?(?:{name})"), 85 + specific, 0.95))
            out.append(_rule(label, _pattern(rf"\b(?:{name})"), 70 + specific, 0.8))
        if url != "-":
            out.append(_rule(label, re.compile(url.encode()), 90 + specific, 1.0))
    for line in SINGLE.strip().splitlines():
        label, _, pattern, priority = re.split(r" \| ", line.strip())
        out.append(_rule(label, _pattern(pattern), int(priority), 0.4 + int(priority) / 200))
    for line in SENTENCES.strip().splitlines():
        label, pattern = re.split(r" \| ", line.strip())
        out.append(_rule(label, _pattern(pattern), SENTENCE, 0.75))
    return tuple(sorted(out, key=lambda r: -r.priority))


@lru_cache(maxsize=1)
def anchored() -> dict[bytes, tuple[tuple[frozenset[bytes], int], ...]]:
    """The longest keyword of each alternative -> (its other keywords, number of the rule)."""
    out: dict[bytes, list[tuple[frozenset[bytes], int]]] = {}
    for i, rule in enumerate(rules()):
        for words in rule.keywords:
            first = max(words, key=lambda k: (len(k), k))
            out.setdefault(first, []).append((words - {first}, i))
    return {k: tuple(v) for k, v in out.items()}


@lru_cache(maxsize=1)
def _automaton() -> tuple[ahocorasick.Automaton, np.ndarray]:
    """All anchors as one automaton over bytes, and their lengths."""
    machine = ahocorasick.Automaton()
    for i, word in enumerate(anchored()):
        machine.add_word(word.decode("latin-1"), i)
    machine.make_automaton()
    return machine, np.array([len(k) for k in anchored()])


@dataclass(frozen=True)
class Detection:
    label: str
    start: int
    end: int
    priority: int
    weight: float


def settle(found: list[Detection]) -> list[Detection]:
    """Accepts by priority, length and position; drops what lies within an accepted interval.

    Of the accepted intervals, those in no other one are held by start, and so by end: the last one that starts no later
    than a detection reaches farthest, and is the only one that need be looked at.
    """
    kept: list[Detection] = []
    starts: list[int] = []
    ends: list[int] = []
    for d in sorted(set(found), key=lambda d: (-d.priority, d.start - d.end, d.start, d.label)):
        at = bisect_right(starts, d.start)
        if at and ends[at - 1] >= d.end:
            continue
        kept.append(d)
        first = at - (at > 0 and starts[at - 1] == d.start)
        last = bisect_right(ends, d.end, lo=first)
        starts[first:last], ends[first:last] = [d.start], [d.end]
    return sorted(kept, key=lambda d: (d.start, d.end, d.label))


def scan(text: bytes, anchors: Iterable[bytes] | None = None, filtered: bool = True) -> list[Detection]:
    """Detections in a lower-cased text. anchors: those known to occur; found here if not given. filtered: only rules with all keywords are tried."""
    if filtered:
        own = [k for k in anchored() if k in text] if anchors is None else anchors
        numbers = sorted({i for a in own for others, i in anchored()[a] if all(k in text for k in others)})
    else:
        numbers = range(len(rules()))
    tried = [rules()[i] for i in numbers]
    return settle([Detection(r.label, *m.span("id" if "id" in r.pattern.groupindex else 0), r.priority, r.weight) for r in tried for m in r.pattern.finditer(text)])


def anchor_texts(blob: bytes, offsets: np.ndarray) -> dict[int, set[bytes]]:
    """text number -> anchors in it, by one walk over all texts; matches across texts don't count."""
    machine, sizes = _automaton()
    found = list(machine.iter(blob.decode("latin-1")))
    if not found:
        return {}
    last, number = np.array(found, np.int64).T
    first = last + 1 - sizes[number]
    text = np.searchsorted(offsets, first, "right") - 1
    inside = last < offsets[text + 1]
    words, out = list(anchored()), {}
    for i, k in np.unique(np.stack((text, number), 1)[inside], axis=0).tolist():
        out.setdefault(i, set()).add(words[k])
    return out


def base_places(words: Words, h: np.ndarray, blob: bytes) -> list[tuple[str, np.ndarray]]:
    """(label, word numbers at which a base phrase stands)."""
    out = []
    for phrase, label in BASE.items():
        parts = phrase.split()
        probe = Words(Texts(pa.array([phrase])), WORD_BY_ALNUM, True).hashes()
        n = len(h) - len(parts) + 1
        if n <= 0:
            continue
        hit = np.flatnonzero(h[:n] == probe[0])
        for k in range(1, len(parts)):
            hit = hit[h[hit + k] == probe[k]]
        doc = np.searchsorted(words.at, hit, "right")
        hit = hit[doc == np.searchsorted(words.at, hit + len(parts) - 1, "right")]
        same = [all(blob[words.starts[i + k] : words.ends[i + k]] == p.encode() for k, p in enumerate(parts)) for i in hit]
        out.append((label, hit[np.array(same, bool)] if len(hit) else hit))
    return out


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,start:int,end:int,priority:int>>"


def _scan_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        texts = Texts(part.column("text"))
        words = Words(texts, WORD_BY_ALNUM, True)
        blob, n = texts.bytes.tobytes().lower(), len(texts)
        base = base_places(words, words.hashes(), blob)
        count, first, last = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
        labels: dict[int, set[str]] = {}
        for label, at in base:
            doc = np.searchsorted(words.at, at, "right") - 1
            np.add.at(count, doc, 1)
            for d, w in zip(doc.tolist(), (at - words.at[doc]).tolist(), strict=True):
                first[d] = w if first[d] < 0 else min(first[d], w)
                last[d] = max(last[d], w)
                labels.setdefault(d, set()).add(label)
        found = {i: scan(blob[texts.offsets[i] : texts.offsets[i + 1]], ks) for i, ks in anchor_texts(blob, texts.offsets).items()}
        score = [1.0 if i in labels else 1 - float(np.prod([1 - d.weight for d in found.get(i, ())])) for i in range(n)]
        none = first < 0
        yield pa.RecordBatch.from_arrays(
            [
                *[part.column(c) for c in part.schema.names if c != "text"],
                pa.array(words.counts),
                pa.array(count),
                pa.array(first, mask=none),
                pa.array(last, mask=none),
                pa.array([",".join(sorted(labels.get(i, ()))) for i in range(n)]),
                pa.array([",".join(sorted(labels.get(i, set()) | {d.label for d in found.get(i, ())})) for i in range(n)]),
                pa.array(score),
                pa.array([[{"label": d.label, "start": d.start, "end": d.end, "priority": d.priority} for d in found.get(i, ())] for i in range(n)], pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("priority", pa.int32())]))),
            ],
            names=[*[c for c in part.schema.names if c != "text"], "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
        )


def scan_licenses(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns `keep` and, for each row, word count, base phrases and settled detections (byte spans)."""
    source = carried(docs, keep, text)
    fields = source.schema.fields[:-1]
    return named(source.mapInArrow(_scan_batches, with_fields(fields, SCHEMA)), keep)
