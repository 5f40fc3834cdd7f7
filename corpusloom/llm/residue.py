"""Template residue, filler and error pages.

Three detectors look at a text after quoted code has been taken out of it (fenced blocks, text between
backticks, code elements), as texts that show a template as code only speak about it:

placeholder   a grammar for each kind of delimiter. Delimiters that ordinary text never uses take any
              name; ambiguous ones (single braces, angle and square brackets, single percent signs) only
              take names of template fields, calls to fill something in, or any name in a place that is
              there to be filled (behind a salutation, say). Values that were never rendered count where
              they stand for a value. A hit is discounted where the words around it quote or explain it;
              a text where as many hits are explained as not speaks about them. Doubled brackets and
              angles also mark links and operators: names that are no fields are weighed by how densely
              such marks stand.
filler        a stretch of words of one filler vocabulary, or a filler sentence said more than once or alone.
error         sentences of error pages, program errors, browser checks and scripts-required notices,
              matched from start to end, and too little other text beside them to be content. Lines
              that are menus are no content, whatever their number.

A null or empty text is no case. Copies are judged alike.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import slices

# Names of template fields; words in brackets that belong to content; filler words.
FIELDS = """name first_name last_name full_name user username user_name email phone address city state country zip company title subject
date day month year time amount price total url link summary section speaker editor author product order_no order_id order_number
batch_id shard_name lane_name doc_title episode item item_id category description content body text heading headline tag topic
account customer client signature location venue language lang count number value field id customer_name
ಹೆಸರು ದಿನಾಂಕ ವಿಳಾಸ ಲೇಖಕ ಶೀರ್ಷಿಕೆ ವಿಷಯ ಬೆಲೆ ಊರು ನಗರ ಸಮಯ ಸ್ಥಳ ಲೇಖಕರು ಸಂಪಾದಕ ದೂರವಾಣಿ ಇಮೇಲ್ ಮೊತ್ತ ವರ್ಷ ತಿಂಗಳು ಸಾರಾಂಶ ಭಾಷಣಕಾರ""".split()
LATIN_FILLER = """lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt ut labore et dolore magna aliqua enim
minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure reprehenderit voluptate
velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa qui officia deserunt mollit anim est
laborum nullam sapien faucibus cursus viverra blandit congue porta tellus lectus vitae ornare pretium feugiat rutrum dapibus mauris
justo vestibulum pellentesque curabitur praesent sagittis vivamus fermentum donec malesuada""".split()
KEYBOARD_FILLER = """blah asdf qwerty xxx xxxx foo bar baz test qux jkl asdfgh zxcv zxcvbn hjkl yyy zzz bla dummy""".split()
FILLER_SENTENCES = (
    r"(?:this is )?(?:some |a )?(?:placeholder|sample|dummy|filler) (?:text|copy|content|paragraph)(?: (?:for|of|in) (?:the|this) [\w ]{1,40})?",
    r"(?:this is )?(?:some |a )?(?:placeholder|sample|dummy|filler|example) (?:text|copy|content|paragraph|sentence)",
    r"(?:type|write|enter|insert|add|put|click to add|tap to add) (?:something|(?:your |some |a )?(?:\w+ )?(?:text|content|copy|description|title|caption|paragraph|body|story|bio|message|subtitle|heading)(?: goes)?)(?: here)?",
    r"(?:your|the) (?:\w+ )?(?:text|content|copy|description|title|caption|story|headline) (?:goes |comes )?here",
    r"(?:click|tap|double.click) here to (?:add|edit|type|insert)[^.!?\n]{0,60}",
    r"ನಿಮ್ಮ (?:ಪಠ್ಯ|ವಿಷಯ|ವಿವರಣೆ) ಇಲ್ಲಿ (?:ಬರುತ್ತದೆ|ಬರಲಿದೆ|ಸೇರಿಸಿ|ಬರೆಯಿರಿ)|ಏನಾದರೂ (?:ಬರೆಯಿರಿ|ಟೈಪ್ ಮಾಡಿ)|ನಿಮ್ಮ (?:ಪಠ್ಯ|ವಿಷಯ|ವಿವರಣೆ)(?:ವನ್ನು|ಯನ್ನು) ಇಲ್ಲಿ (?:ಸೇರಿಸಿ|ಬರೆಯಿರಿ)",
    r"(?:text|content) (?:goes|to go|comes) here",
    r"ಮಾದರಿ ಪಠ್ಯ",
    r"(?:ಪಠ್ಯ|ವಿಷಯ|ಲೇಖನ) ಇಲ್ಲಿ (?:ಬರುತ್ತದೆ|ಬರಲಿದೆ|ಸೇರಿಸಿ|ಬರೆಯಿರಿ)",
    r"ಇಲ್ಲಿ (?:ಪಠ್ಯ|ವಿಷಯ) (?:ಬರುತ್ತದೆ|ಬರಲಿದೆ|ಸೇರಿಸಿ|ಬರೆಯಿರಿ)",
)
FILLER_RUN = 8
#: The length from which a run of one or two different filler words counts: a shorter one may be said for emphasis.
FEW_KINDS_RUN = 12

_code = regex.compile(r"```.*?(?:```|\Z)|~~~\n.*?(?:~~~|\Z)|``[^\n]*?``|`[^`\n]*`|<(code|pre)\b[^>]*>.*?</\1>", regex.S | regex.I).sub

_NAME = r"[\p{L}_][\p{L}\p{M}\p{N}_.‌‍-]{0,40}"
_FIELD = "(?:" + "|".join(sorted((regex.escape(f) for f in FIELDS), key=len, reverse=True)) + r"|[a-z]+(?:_[a-z0-9]+)+)"
_UPPER = "(?:" + "|".join(sorted((f.upper() for f in FIELDS if f.isascii()), key=len, reverse=True)) + r"|[A-Z]+(?:_[A-Z0-9]+)+)"
_CAPITAL_FIELD = "|".join(sorted((f.upper() for f in FIELDS if f.isalpha() and f.isascii()), key=len, reverse=True))
_KN_FIELD = "(?:" + "|".join(sorted((f for f in FIELDS if not f.isascii()), key=len, reverse=True)) + ")"
_FILL_VERB = r"(?:insert|enter|add|type|your|put|fill in|choose|select|write)"
_KN_FILL = r"(?:ಬರೆಯಿರಿ|ಸೇರಿಸಿ|ನಮೂದಿಸಿ|ಹಾಕಿ|ತುಂಬಿ|ಟೈಪ್ ಮಾಡಿ|ಭರ್ತಿ ಮಾಡಿ)"

#: A grammar for each delimiter.
GRAMMARS = {
    "double or triple braces": r"\{\{\{?-?\s*[#/^&>!$]?\s*" + _NAME + r"(?:\s*[|:][^{}\n]{0,60}|\s+[^{}\n]{0,60})?\s*-?\}?\}\}",
    "brace and percent": r"\{%-?\s*[\p{L}_][^{}%\n]{0,80}%\}",
    "dollar brace": r"\$\{\s*" + _NAME + r"(?:[|:!?-][^{}\n]{0,60})?\s*\}",
    "brace dollar": r"\{\$" + _NAME + r"(?:\|[^{}\n]{0,60})?\}",
    "hash brace": r"#\{\s*" + _NAME + r"\s*\}",
    "single braces": r"(?<![\w\\^$#{])\{\s?(?:" + _FIELD + r")\s?\}(?!\})",
    "percent tag": r"<%[=\-#]?[^<>%\n]{0,80}%>",
    "escaped percent tag": r"&lt;%[=\-#]?(?:(?!%&gt;)[^\n]){0,80}%&gt;",
    "question tag": r"<\?(?:=|php)[^<>\n]{0,80}\?>",
    "escaped question tag": r"&lt;\?(?:=|php)(?:(?!\?&gt;)[^\n]){0,80}\?&gt;",
    "format": r"%\(\s*" + _NAME + r"\s*\)[-+0-9.]*[sdifrx]",
    "double percent": r"%%" + _NAME + r"%%",
    "single percent": r"(?<![\p{L}\p{M}\p{N}%_])%" + _FIELD + r"%(?![\p{L}\p{N}%])",
    "underscores": r"(?<![\p{L}\p{N}_])__(?:[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*|" + _KN_FIELD + r")__(?![\p{L}\p{N}_])",
    "at signs": r"@@" + _NAME + r"@@",
    "tildes": r"(?<![\p{L}\p{N}~])~(?:" + _UPPER + "|" + _KN_FIELD + r")~(?![\p{L}\p{N}~])",
    "double angles": r"<<\s*(?P<name>" + _NAME + r")\s*>>|&lt;&lt;\s*" + _NAME + r"\s*&gt;&gt;|«" + _FIELD + r"»",
    "single angles": r"(?<![\p{L}\p{N}<])<(?:(?!title>|body>|link>|section>|summary>|time>|address>)" + _FIELD + r"|(?:title|summary|section|address)(?=>(?:(?!</).)*\Z)|(?i:" + _FILL_VERB + r")\s[^<>\n]{1,40})>(?!>)",
    "double brackets": r"\[\[\s*(?P<name>" + _NAME + r")\s*\]\]",
    "bracket and hash": r"\[#" + _NAME + r"#\]",
    "brackets": r"(?<!\[)\[(?:" + _UPPER + "|(?:[A-Z]+ ){1,3}(?:" + _CAPITAL_FIELD + ")|(?:" + _CAPITAL_FIELD + ")(?: [A-Z]+){1,3}|" + _KN_FIELD + r"|TBD|TBA|TBC|TODO|FIXME|PLACEHOLDER|XX+)\](?![\](])",
    "bracketed call": r"\[(?i:" + _FILL_VERB + r"\s[^\[\]\n]{1,60}|[^\[\]\n]{1,60}\s(?:to be (?:added|filled|confirmed|decided|inserted|announced|supplied)|goes here|here))\]",
    "bracketed Kannada call": r"[\[(<{](?:[^\[\](){}<>\n]{0,40}\s)?ಇಲ್ಲಿ\s[^\[\](){}<>\n]{0,40}?" + _KN_FILL + r"[\])>}]|[\[(<{][^\[\](){}<>\n]{1,40}\s" + _KN_FILL + r"[\])>}]",
    "parenthesised call": r"\((?i:" + _FILL_VERB + r"\s[^()\n]{1,40}\shere)\)|\([^()\n]{1,40}\s(?:GOES|COMES|TO GO)\sHERE\)",
    "note to self": r"\b(?:TODO|FIXME|TBD)\s?:\s*(?i:add|insert|write|fill|replace|complete|update|describe)\b",
    "mask": r"(?<![\p{L}\p{N}/])(?:XX/XX/XX(?:XX)?|DD/MM/YYYY|MM/DD/YYYY|YYYY-MM-DD|XX-XX-XXXX|XXX-XXX-XXXX|\bHH:MM\b)(?![\p{L}\p{N}/])",
    "unrendered object": r"\[object [A-Z]\w*\]|(?<![\p{L}\p{N}_.])(?:#(?:REF|N/A|VALUE|NAME\?)!?)(?![\p{L}\p{N}])",
    "salutation": r"(?<![\p{L}\p{M}\p{N}])(?i:dear|hello|hi|hey|welcome(?: back)?|greetings|thank you|thanks|sincerely|regards|sent to|posted by|written by|signed by|prepared for|addressed to|ನಮಸ್ಕಾರ|ಪ್ರಿಯ|ಆತ್ಮೀಯ|ಸ್ವಾಗತ),?\s(?:\{[\p{L}_][\p{L}\p{M}\p{N}_ .]{1,40}\}|<[\p{L}_][\p{L}\p{M}\p{N}_ ]{1,40}>|\[\p{Lu}[\p{L}\p{M}\p{N}_'’]*(?: \p{Lu}[\p{L}\p{M}\p{N}_'’]*){0,4}\](?![\](]))",
    "unrendered value": r"(?<![\p{L}\p{N}_.'\"“‘(-])(?:undefined|NaN|null|None)(?=(?:\s\p{Kannada})|[.,!?;:]|\s*\Z|\s(?:and|on|by|before|begins|in|was|will|the|our|is)\b)(?!\s(?:behaviou?r|variable|pointer|value|hypothesis|of\b))",
}
_placeholder = [(kind, regex.compile(g, regex.S if kind == "single angles" else 0)) for kind, g in GRAMMARS.items()]
_may_hold = regex.compile(r"[\[{<%@~«]|__|#\{|&lt;|\((?:\p{Lu}|\p{Kannada}|\p{Ll}+ )|TODO|FIXME|TBD|XX|DD/|MM/|YYYY|HH:|undefined|NaN|null|None|#(?:REF|N/A|VALUE|NAME)").search

#: What stands before or behind a mark that is spoken about.
_EXPLAINED_BEFORE = (
    r"(?:like|such as|called|named|known as|as in|e\.g\.|i\.e\.|for example|for instance|namely|literal(?:ly)?|means?|denotes?|spelled|using|use|type|write|writes|writing|typing|the (?:double |single |curly )?"
    r"(?:mark|marker|placeholder|variable|tag|token|syntax|field|expression|string|macro|notation|pattern|template|construct|operator|delimiters?|braces?|brackets?|link|form|sequence|symbol))[,:]?\s(?:an? |the )?[\"'“‘(]?$"
)
_EXPLAINED_BEHIND = (
    r"^[\"'”’)]?,?\s(?:(?:is|are|was|were|gets?|will be|would be|can be|must be|should be|has to be)\s(?:then |always |later |never )?(?:replaced|filled|rendered|substituted|expanded|swapped|parsed|resolved|evaluated|interpreted|escaped|written|read as|turned into|called|an? |the (?:placeholder|variable|tag|syntax|name|value|mark))"
    r"|(?:stands? for|means?|denotes?|refers? to|marks? (?:the|a|where)|inserts?|prints?|outputs?|renders?|expands?)\s|(?:style|syntax|placeholders?|notation|tags?|variables?|markers?|delimiters?|expressions?|macros?|marks?|operators?|links?|tokens?)(?![\p{L}\p{N}])|to (?:print|insert|show|mark|output|refer|display|render)\s|as (?:an? |the )?(?:field|placeholder|variable|tag|marker|name|token|symbol)(?![\p{L}\p{N}])|ಎಂದು (?:ಬರೆ|ಕರೆ)|ಎಂಬ (?:ಗುರುತು|ಚಿಹ್ನೆ))"
)
_before, _behind = regex.compile("(?i)" + _EXPLAINED_BEFORE).search, regex.compile("(?i)" + _EXPLAINED_BEHIND).search
_QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’"}
_field = regex.compile(r"(?i:" + "|".join(sorted((regex.escape(f) for f in FIELDS), key=len, reverse=True)) + r")|[a-z]+(?:_[a-z0-9]+)+|[A-Z]+(?:_[A-Z0-9]+)*").fullmatch
_linked = regex.compile(r"\[\[[^\[\]\n]{1,80}\]\]|<<[^<>\n]{1,40}>>").findall
#: Doubled brackets or angles with different contents from which a text uses them as links or operators.
LINKS = 3

_latin = frozenset(LATIN_FILLER)
_keys = frozenset(KEYBOARD_FILLER)
_word = regex.compile(r"[\p{L}\p{M}\p{N}_‌‍]+")
_filler_sentence = regex.compile(r"(?i)(?<![\p{L}\p{M}\p{N}])(?:" + "|".join(FILLER_SENTENCES) + r")(?:[.!।]|(?=\s|\Z))")
_quoted = regex.compile(r"(?<![\p{L}\p{M}\p{N}])'[^'\n]{1,80}'(?![\p{L}\p{M}\p{N}])|\"[^\"\n]{1,80}\"|“[^”\n]{1,80}”|‘[^’\n]{1,80}’").sub

_JS = r"(?:java ?script|js|(?:client-side )?scripts?|scripting|ಜಾವಾ ?ಸ್ಕ್ರಿಪ್ಟ್|ಸ್ಕ್ರಿಪ್ಟ್(?:‌?ಗಳು|‌?ಗಳನ್ನು|‌ಗಳನ್ನು)?)"
_WHAT = r"(?:page|site|website|file|resource|recording|article|document|address|url|link|content|story|item|record|video|image|photo|picture|product|listing|post|account|service|feature|channel)"
#: Sentences that error pages, failed programs, browser checks and script notices consist of.
NOTICES = (
    r"(?:http )?(?:status |error |ದೋಷ )?(?:code )?[45]\d\d\s*[:–-]?\s*(?:not found|forbidden|bad gateway|service unavailable|internal server error|gateway time-?out|bad request|unauthorized|too many requests|gone|request time-?out|moved)",
    r"(?:http status|status code|http error|http|error code|error|ದೋಷ)\s*[45]\d\d",
    r"(?:page|file) (?:not found|unavailable|cannot be displayed)|(?:access|permission) denied|bad request|bad gateway|service (?:temporarily )?unavailable|internal server error|gateway time-?out|server error|too many requests|not found|forbidden|unauthorized",
    r"(?:oops[!,.]?\s*)?something went wrong|an (?:unexpected |internal )?error (?:has )?occurred|(?:we are )?sorry[,.]? [^.!?\n]{0,60}(?:went wrong|not available|error|not found|does not exist)",
    r"(?:the|this) (?:requested )?" + _WHAT + r"(?: (?:that )?you (?:asked for|tried to (?:open|reach|view)|requested|followed|are looking for|were looking for|wanted|selected|clicked))?(?: was)? (?:could not be (?:found|loaded|shown|displayed)|cannot be (?:found|loaded|shown|displayed|opened)|was not found(?: on this server)?|not found|does not exist|doesn't exist|is (?:currently |temporarily )?(?:not available|unavailable|no longer (?:here|available)|broken|gone|missing|not here)|has (?:been )?(?:moved|removed|deleted|expired)|was (?:removed|deleted|moved)|no longer exists|removed)[^.!?\n]{0,50}",
    r"(?:the|this|our) (?:upstream |origin |web |remote )?(?:server|gateway|host|proxy|backend|site|service|database|application) (?:did not|failed to|is not|is too|is (?:currently |temporarily )?(?:busy|down|overloaded|unreachable|unavailable|offline)|met an?|refused|returned an?|encountered an?|could not|cannot be|has (?:failed|crashed)|took too long|timed out)[^.!?\n]{0,70}",
    r"(?:oops|whoops|sorry|ಕ್ಷಮಿಸಿ|ಅಯ್ಯೋ)\s?!",
    r"error establishing an? [^.!?\n]{0,40}connection|(?:database|connection) (?:error|refused|timed out|failed)",
    r"your (?:session|login|link) has expired[^.!?\n]{0,40}|please (?:check|verify) the (?:address|url|link)[^.!?\n]{0,40}|(?:please )?try again (?:later|in a few[^.!?\n]{0,20})|retry in a few[^.!?\n]{0,20}",
    r"we are working on it[^.!?\n]{0,40}|please come back later|(?:site|page|website|server) (?:is )?under (?:maintenance|construction)|(?:down for|scheduled) maintenance|temporarily (?:down|unavailable)[^.!?\n]{0,30}",
    r"use the search box[^.!?\n]{0,50}|(?:go|return|back) (?:back )?to (?:the )?(?:home ?page|home|main page)|contact the (?:site )?(?:administrator|webmaster|owner)[^.!?\n]{0,30}",
    r"you do(?: not|n't) have (?:permission|access)[^.!?\n]{0,60}|this (?:page|site|content) (?:is|has been) (?:blocked|removed|not available|unavailable)[^.!?\n]{0,40}",
    r"(?:reference|request id|ray id|incident id|error id|ticket|support id|trace id)\s*[#:]{0,2}\s*#?[\p{N}a-f/-]{3,40}|apache(?:/[\d.]+)? (?:server )?(?:at )?[^.!?\n]{0,40}port \d+|nginx(?:/[\d.]+)?",
    r"fatal error\s*:[^\n]{0,120}|uncaught (?:exception|error|typeerror)[^\n]{0,120}|(?:parse|syntax|runtime) error\s*:[^\n]{0,100}|segmentation fault[^\n]{0,40}|core dumped|(?:warning|notice)\s*:\s*[a-z_]+\(\)[^\n]{0,100}",
    r"traceback \(most recent call last\)\s*:?|file \"[^\"\n]+\", line \d+(?:, in [\w.<>]+)?|(?:[\w.]*\.)?\w*(?:Error|Exception)\b(?:\s*:[^\n]{0,80})?|at [\w.$<>]+\([\w.]*(?::\d+)?\)|caused by\s*:[^\n]{0,80}|stack trace\s*:?|exception in thread[^\n]{0,80}",
    r"(?:php )?(?:warning|notice|deprecated|parse error)\s*:\s*[\w\\:]+\([^()\n]{0,60}\)[^\n]{0,160}|[A-Z]{2,5}-\d{4,6}\s*:[^\n]{0,80}|sqlstate\s*\[[^\]\n]{1,12}\][^\n]{0,120}|(?:my)?sql(?: syntax)? error[^\n]{0,100}|query failed[^\n]{0,60}|call to undefined (?:function|method)[^\n]{0,80}|cannot read propert[^\n]{0,80}|[\w.]+ is not (?:defined|a function)|no such file or directory[^\n]{0,80}",
    r"(?:we're|we are) sorry,? but [^.!?\n]{1,60} without " + _JS + r"[^.!?\n]{0,40}",
    r"checking (?:your browser|if the site connection is secure)[^.!?\n]{0,60}|(?:please )?(?:verify|confirm|prove|make sure)(?: that)? you(?:'re| are) (?:not a robot|human|a human)[^.!?\n]{0,30}|just a moment|(?:please )?complete the (?:captcha|security check)[^.!?\n]{0,40}|attention required|one more step|unusual (?:traffic|activity)[^.!?\n]{0,60}|ddos protection by [^.!?\n]{0,30}|this process is automatic[^.!?\n]{0,60}|your browser will redirect[^.!?\n]{0,60}|please (?:wait|stand by)[^.!?\n]{0,40}",
    r"(?:you need|please|you must|you have|kindly)?\s*(?:to )?(?:enable|turn on|activate|allow|switch on) " + _JS + r"(?: and cookies)?[^.!?\n]{0,60}",
    r"(?:this|the|our) (?:site|page|app|application|website|content) (?:requires|needs|relies on|works best with|will not work without|does not work without) " + _JS + r"[^.!?\n]{0,40}",
    r"(?:your|this) browser (?:does not|doesn't|do not) support " + _JS + r"[^.!?\n]{0,60}|" + _JS + r" (?:is|are|has been|must be|seems to be) (?:disabled|required|blocked|turned off|off|needed|not enabled|enabled|switched off)[^.!?\n]{0,60}|some parts of this page will not work|if nothing appears[^.!?\n]{0,60}|then reload(?: the page)?|reload the page[^.!?\n]{0,30}",
    r"(?:[\p{Kannada}‌‍]+ ){1,4}" + _JS + r" (?:ಅಗತ್ಯವಿದೆ|ಬೇಕು|ಆನ್ ಮಾಡಿ|ಸಕ್ರಿಯಗೊಳಿಸಿ|ಸಕ್ರಿಯವಾಗಿರಬೇಕು|ಅಗತ್ಯ)|" + _JS + r" (?:ಅಗತ್ಯವಿದೆ|ಬೇಕು|ಆನ್ ಮಾಡಿ|ಸಕ್ರಿಯಗೊಳಿಸಿ|ನಿಷ್ಕ್ರಿಯವಾಗಿದೆ|ಆಫ್ ಆಗಿದೆ)",
    r"(?:ಕ್ಷಮಿಸಿ[,.!]?\s*)?ಪುಟ (?:ಸಿಗಲಿಲ್ಲ|ಕಂಡುಬಂದಿಲ್ಲ|ಲಭ್ಯವಿಲ್ಲ)|ಸರ್ವರ್ ದೋಷ(?![\p{L}\p{M}])|ಪ್ರವೇಶ ನಿರಾಕರಿಸಲಾಗಿದೆ|ದೋಷ ಸಂಭವಿಸಿದೆ",
    r"(?:ನೀವು (?:ಕೇಳಿದ|ಹುಡುಕಿದ|ಕೋರಿದ|ತೆರೆಯಲು ಯತ್ನಿಸಿದ|ಬಯಸಿದ)|ಈ|ಆ|ಕೋರಿದ|ಕೇಳಿದ) (?:ಪುಟ|ಲೇಖನ|ಕಡತ|ಧ್ವನಿಮುದ್ರಣ|ಜಾಲತಾಣ|ವಿಳಾಸ|ಕೊಂಡಿ|ದಾಖಲೆ|ಚಿತ್ರ|ವಿಡಿಯೋ|ತಾಣ|ಸೇವೆ)(?:ವನ್ನು)? (?:[\p{Kannada}‌‍]+ ){0,4}(?:ಇಲ್ಲ|ತೆರೆಯುವುದಿಲ್ಲ|ತೆರೆಯುತ್ತಿಲ್ಲ|ತೆಗೆದುಹಾಕಲಾಗಿದೆ|ಸಿಗಲಿಲ್ಲ|ಸಿಗುವುದಿಲ್ಲ|ಲಭ್ಯವಿಲ್ಲ|ದೊರೆಯುವುದಿಲ್ಲ|ದೊರೆಯಲಿಲ್ಲ|ಅಸ್ತಿತ್ವದಲ್ಲಿಲ್ಲ|ಕಂಡುಬಂದಿಲ್ಲ|ಅಳಿಸಲಾಗಿದೆ)",
    r"(?:ದಯವಿಟ್ಟು )?ವಿಳಾಸ(?:ವನ್ನು)? (?:[\p{Kannada}‌‍]+ )?(?:ಪರಿಶೀಲಿಸಿ|ಸರಿಪಡಿಸಿ)",
    r"ತಾಂತ್ರಿಕ (?:ತೊಂದರೆ|ದೋಷ)[\p{Kannada}‌‍]*(?: [\p{Kannada}‌‍]+){0,4}|(?:ಸ್ವಲ್ಪ ಸಮಯದ ನಂತರ|ದಯವಿಟ್ಟು|ನಂತರ) (?:[\p{Kannada}‌‍]+ ){0,3}ಪ್ರಯತ್ನಿಸಿ",
)
#: Frames of stack traces, each with its source line and the marks under it: a source line is indented, or stands before the next frame or the error on the frame's own line.
FRAMES = (
    r"file \"[^\"\n]{1,300}\", line \d+(?:, in [^\s,]{1,100}(?:[ \t]+(?!file \")[^\n]{1,300}?(?=[ \t]+(?:file \"|(?:\w+\.)*\w*(?:error|exception)(?::|[ \t]*$))))?)?(?:[ \t]*\n[ \t]{2,}(?!file \"|at )[^\n]{1,400}){0,2}",
    r"\bat [\w.$/<>@-]{1,300}\((?:[\w$.-]+(?::\d+)?|native method|unknown source)\)(?:[ \t]+~?\[[^\]\n]{1,100}\])?",
    r"\bat (?:async |new )?(?:[\w.$<>\[\]]{1,100} (?:\[as \w+\] )?)?\(?(?:[^\s()]{1,300}\.[a-z]{1,5}|node:[\w/]+|<anonymous>):\d+:\d+\)?",
    r"#\d+ (?:[^\s()]{1,300}\(\d+\): [^\n]{1,200}|\{main\})",
    r"\.\.\. \d+ (?:more|common frames omitted)",
)
_frame = regex.compile(r"(?im)(?:" + "|".join(FRAMES) + ")")
_may_frame = regex.compile(r"(?i)file \"[^\"\n]{1,300}\", line \d|\bat [^\n(]{1,300}\([^()\n]{1,300}\)|\bat [^\n]{1,300}:\d+:\d|#\d+ [^\n]{1,300}\(\d+\): ").search
#: Stands for a frame that was found; a noncharacter, so no text has it.
FRAME = "\uffff"
_notice = regex.compile(r"(?i)(?<![\p{L}\p{M}\p{N}])(?:" + "|".join((*NOTICES, FRAME)) + r")(?![\p{L}\p{M}\p{N}])")
_menu = regex.compile(r"(?i)\b(?:skip to content|menu|back to home|home|search|sign in|log in|contact|about)\b|ಮುಖಪುಟ|ಸುದ್ದಿ|ಸಂಪರ್ಕ|ಲೇಖನ|ಅಂಕಣ|ಹಿಂದಕ್ಕೆ ಹೋಗಿ|ಹುಡುಕಿ")
# Words of navigation.
NAVIGATION = """home news sport sports weather business politics world opinion culture travel video videos photos gallery about contact login logout log in sign
up register help faq privacy policy terms sitemap site map search subscribe newsletter menu archive archives categories category tags blog shop store cart
account profile settings careers jobs advertise cookies rss twitter facebook instagram youtube share print email back next previous top skip to content main
events services products support download downloads documentation docs forum community team company press media partners science health technology tech
education entertainment lifestyle local national international latest popular trending topics sections features reviews music movies books food all more
us you our the and of in my start explore discover library language english kannada ಮುಖಪುಟ ಸುದ್ದಿ ಸಂಪರ್ಕ ಲೇಖನ ಲೇಖನಗಳು ಅಂಕಣ ಹುಡುಕಿ ಕ್ರೀಡೆ ಹವಾಮಾನ ವಾಣಿಜ್ಯ
ರಾಜಕೀಯ ಜಗತ್ತು ಅಭಿಪ್ರಾಯ ಸಂಸ್ಕೃತಿ ವಿಡಿಯೋ ಚಿತ್ರಗಳು ಸಿನಿಮಾ ಮನರಂಜನೆ ಆರೋಗ್ಯ ತಂತ್ರಜ್ಞಾನ ಶಿಕ್ಷಣ ಸಹಾಯ ಪ್ರವೇಶ ನೋಂದಣಿ""".split()
_navigation = frozenset(NAVIGATION)
_entries = regex.compile(r"\s*[|•·»›>/,\t]\s*|\s{2,}").split
#: Words beside the notices, menus aside, that a headline and no content has at most.
HEADLINE = 30
# What every notice, and every filler, holds in lower case.
NOTICE_KEYS = """not found|be found|forbidden|gateway|unavailable|bad request|internal server|time-out|timeout|timed out|unauthor|denied|not exist
not available|removed|has moved|been moved|expired|is broken|no longer|server|connection|try again|retry in|come back later|working on it
maintenance|under construction|search box|home page|back to home|permission|blocked|reference #|request id|ray id|incident id|ticket|apache
nginx|fatal error|uncaught|exception|error|segmentation|core dumped|traceback|file "|checking|verify|robot|human|just a moment|captcha|ddos
please wait|stand by|redirect|java script|javascript| js|js |scripts|scripting|not support|ಸ್ಕ್ರಿಪ್ಟ್|ಪುಟ|ದೋಷ|ನಿರಾಕರಿಸ|ತೆರೆಯು|ತಾಂತ್ರಿಕ|ಪ್ರಯತ್ನಿಸಿ
ಲಭ್ಯವಿಲ್ಲ|ora-|sqlstate|query failed|warning:|no such file|http|went wrong|gone|too many requests|is not defined|not a function|notice:
backend|no longer here|be shown|this site|security check|one more step|unusual t|unusual a|too busy|reachable|refused|oops|ಕ್ಷಮಿಸಿ|ದೊರೆಯು|ಅಸ್ತಿತ್ವ|ಸಿಗ|ಪರಿಶೀಲಿಸಿ|ಕಡತ|ಅಳಿಸ|undefined f|cannot read|parse error|stack trace|caused by|reload""".replace("\n", "|").split("|")
FILLER_KEYS = """lorem|ipsum|amet|blah|asdf|qwerty|xxxx|foo bar|test test|dolor|aliqua|tempor|faucibus|placeholder|sample text|sample co|sample pa|dummy|filler
type s|type y|write s|goes here|here to|click|add your|add a|your text|your content|text here|content here|title here|something|example text|example se
enter your|insert your|add some|put your|tap to|description|ಪಠ್ಯ|ಏನಾದರೂ|ವಿಷಯ ಇಲ್ಲಿ|ಇಲ್ಲಿ ವಿಷಯ|ಲೇಖನ ಇಲ್ಲಿ|ವಿವರಣೆ""".replace("\n", "|").split("|")
_keyed = ahocorasick.Automaton()
# Short Latin words are parts of many others, so they are sought with what stands around them.
_latin_keys = [k for w in LATIN_FILLER for k in ([w] if len(w) > 3 else [a + w + b for a in " \n\t" for b in " ,.\n\t"])]
for _k in {*NOTICE_KEYS, *FILLER_KEYS, *_latin_keys, *KEYBOARD_FILLER}:
    _keyed.add_word(_k, (_k in NOTICE_KEYS, _k in FILLER_KEYS, _k in _latin_keys, _k in _keys))
_keyed.make_automaton()


def _explained(text: str, at: int, end: int) -> bool:
    """Whether the words around text[at:end] quote or explain it."""
    if at and end < len(text) and _QUOTES.get(text[at - 1]) == text[end]:
        return True
    return bool(_before(text[max(0, at - 60) : at].rsplit("\n", 1)[-1]) or _behind(text[end : end + 60].split("\n", 1)[0]))


def _a_field(name: str | None, links: int) -> bool:
    """Whether a name in doubled brackets or angles, of a text with so many different ones, is one to be filled in, rather than a link or an operand."""
    return name is None or bool(_field(name)) or len(name) > 2 and name.islower() and links < LINKS


def placeholder(text: str) -> str | None:
    """The kind of placeholder that text, free of code, has: of the first hit that the words around it do not explain, where fewer hits are explained than not."""
    if not _may_hold(text):
        return None
    kinds, explained, links = [], 0, None
    for kind, grammar in _placeholder:
        for m in grammar.finditer(text):
            if kind in ("double brackets", "double angles"):
                links = len(set(_linked(text))) if links is None else links
                if not _a_field(m.groupdict().get("name"), links):
                    continue
            if kind != "salutation" and _explained(text, *m.span()):
                explained += 1
            else:
                kinds.append(kind)
    return kinds[0] if len(kinds) > explained else None


def filler(text: str) -> bool:
    words = _word.findall(text.lower())
    for vocabulary in (_latin, _keys):
        run, kinds = 0, set()
        for w in words:
            if w in vocabulary:
                run += 1
                kinds.add(w)
                if run >= (FILLER_RUN if len(kinds) > 2 else FEW_KINDS_RUN):
                    return True
            else:
                run, kinds = 0, set()
    said = [m.end() - m.start() for m in _filler_sentence.finditer(_quoted(" ", text))]
    return len(said) > 1 or len(said) == 1 and said[0] > 0.5 * len(text.strip())


def _menu_line(line: str) -> bool:
    """Whether a line is a menu: short entries, half of their words or more those of navigation."""
    entries = [e.split() for e in _entries(line.strip()) if e]
    words = [w.strip(".:!?()[]").lower() for e in entries for w in e]
    return bool(words) and (len(entries) > 1 or len(words) <= 3) and all(len(e) <= 4 for e in entries) and 2 * sum(w in _navigation for w in words) >= len(words)


def without_menus(text: str) -> str:
    """text with its menu lines blank."""
    return "\n".join("" if len(x) < 2000 and _menu_line(x) and not _notice.search(x) else x for x in text.split("\n"))


def _reach(text: str, at: int, most: int) -> int:
    """Where the words from at on, menus aside, are surely more than most."""
    size = 400
    while at + size < len(text):
        # some words to spare, as the end of the piece may cut a menu entry
        for k, m in enumerate(_word.finditer(_menu.sub(lambda m: " " * len(m[0]), text[at : at + size]))):
            if k > most + 4:
                return at + m.end()
        size *= 4
    return len(text)


def _next_notice(text: str, at: int, most: int):
    """The first notice from at on, None if more than most words stand before it: content is not read to its end."""
    reach = _reach(text, at, most)
    m = _notice.search(text, at, min(len(text), reach + 400))
    return m if m is None or m.end() < reach + 400 else _notice.search(text, at)


def notice(text: str) -> bool:
    """Whether error or script notices stand where the content should be."""
    text = text.replace(FRAME, " ")
    said = 0
    if _may_frame(text):  # before quotes go: frames hold them
        text, frames = _frame.subn(f" {FRAME} ", text)
        said = 4 * frames
    plain = without_menus(_quoted(" ", text))
    beside = at = found = 0
    while (m := _next_notice(plain, at, HEADLINE - beside)) is not None:
        found += 1
        beside += len(_word.findall(_menu.sub(" ", plain[at : m.start()])))
        said += len(_word.findall(m[0]))
        at = m.end()
        if beside > HEADLINE:
            return False
    if not found or _reach(plain, at, HEADLINE - beside) < len(plain):
        return False
    beside += len(_word.findall(_menu.sub(" ", plain[at:])))
    return beside <= HEADLINE and (said >= 4 or beside <= 2 * said + 12)


def judge(text: str | None) -> str | None:
    """'placeholder', 'filler' or 'error', or null for a text that has none."""
    if not text:
        return None
    plain = _code(" ", text) if "`" in text or "~~~" in text or "<" in text else text
    kind = placeholder(plain)
    if kind:
        return "placeholder"
    notices = fillers = latin = keys = 0
    for _, (n, f, x, y) in _keyed.iter(plain.lower()):
        notices += n
        fillers += f
        latin += x
        keys += y
    if (fillers or latin >= FILLER_RUN - 2 or keys >= FILLER_RUN) and filler(plain):
        return "filler"
    if notices and notice(plain):
        return "error"
    return None


def _judged(batches):
    for whole in batches:
        for b in slices(whole):
            kinds = pa.array([judge(t) for t in b.column(1).to_pylist()], pa.string())
            kept = kinds.is_valid()
            yield pa.RecordBatch.from_arrays([b.column(0).filter(kept), kinds.filter(kept)], names=["doc_id", "residue"])


def residue(documents: DataFrame) -> DataFrame:
    """(doc_id, residue) of the documents that are template residue, filler or an error page. One narrow pass; nothing is shuffled but ids."""
    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(_judged, f"doc_id {kind}, residue string").dropDuplicates(["doc_id"])


def without_residue(documents: DataFrame) -> DataFrame:
    """The documents that are none; those with a null text or id stay."""
    return documents.join(residue(documents).select("doc_id"), "doc_id", "left_anti")
