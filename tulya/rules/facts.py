"""Where a title document states its facts, and what a letterhead looks like."""

OWNER = [
    r"ખરીદનાર[^(\n]*\(([઀-૿][઀-૿ ]*)\)",
    r"લખાવી લેનાર[^(\n]*\(([઀-૿][઀-૿ ]*)\)",
    r"લખાવી લેનાર\s*[:ઃ|\-–]*\s*([઀-૿][઀-૿ ]*)",
]
SELLER = [
    r"વેચનાર[^(\n]*\(([઀-૿][઀-૿ ]*)\)",
    r"લખી આપનાર[^(\n]*\(([઀-૿][઀-૿ ]*)\)",
    r"લખી આપનાર\s*[:ઃ|\-–]*\s*([઀-૿][઀-૿ ]*)",
]
ENTITY = r"એલએલપી|\bLLP\b|પ્રા\.?\s*લિ\.?|પ્રાઇવેટ\s*લિમિટેડ|લિમિટેડ|કંપની|ટ્રસ્ટ"
VILLAGE = [r"ગામનું નામ\s*[:ઃ]?\s*([઀-૿]+)"]
SURVEY = [r"રે\.?\s*સ\.?\s*નં\.?\s*[:ઃ]?\s*([0-9]+)"]
OLD_BLOCK = [r"બ્લોક\s*નં\.?\s*[:ઃ]?\s*([0-9]+)"]
NEW_BLOCK = [r"[0-9]+\s*\(\s*જુનો\s*\)\s*,\s*([0-9]+)\s*\(\s*નવો\s*\)"]
KHATA = [r"ખાતા\s*નં\.?\s*[:ઃ]?\s*([0-9]+)"]
AREA = [r"ક્ષેત્રફળ\s*\(\s*ચો\.મી\.\s*\)\s*[:ઃ]?\s*([0-9,]+)"]
FEE = [r"નોંધણી\s*ફી[^\n]{0,40}?([0-9][0-9,]*)"]
APPLICATION = [r"Application\s*No[^\n]{0,40}?([0-9]{8,})", r"એપ્લિકેશન\s*નં\.?\s*[:ઃ]?\s*([0-9]{6,})"]
DEED_NO = [
    r"(?:દસ્તાવેજ|વેચાણપત્ર)\s*નં\.?\s*[:ઃ]?\s*([0-9]{3,8})",
    r"([0-9]{3,8})\s*નંબરે\s*નોંધ",
    r"Certificate\s+of\s+Stamp(?s:.{0,80}?)[-–—]\s*([0-9]{3,8})\s*\.",
    r"અનુક્રમ[^\n]{0,30}?([0-9]{3,8})",
]
BLOCK_NO = r"બ્લોક\s*નં\.?\s*([0-9]+)"
NOTE = r"નોંધ\s*(?:નં|તં|સં)\.?\s*[:ઃ]?\s*([0-9઀-૿]{2,6})"

WRITTEN_DATE = r"(?:તારીખ|તા\.?)\s*[:ઃ]?\s*([0-9]{1,2})\s*મી\s*[,\s]*(?:માહે\s*[:ઃ]?|મહિનો|માસ)?\s*([઀-૿]+)\s*[,\s]*(?:સને\s*)?([0-9]{4})"
LABELLED_DATE = r"(?:તારીખ|તા\.?)\s*[:ઃ]?\s*([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{2,4})"
RECENT_DATE = r"\b([0-9]{1,2})/([0-9]{1,2})/(20[0-9]{2})\b"
MONTH_STEMS = [
    ("જાન્યુ", 1), ("ફેબ્રુ|ફેબ", 2), ("માર્ચ", 3), ("એપ્રિલ|એપ્રી", 4), ("^મે$", 5), ("જૂન|જુન", 6),
    ("જુલાઈ|જુલાઇ", 7), ("ઓગસ્ટ|ઑગસ્ટ", 8), ("સપ્ટેમ્બર|સપ્ટે", 9), ("ઓકટોબર|ઓક્ટોબર|ઓક્ટોમ્બર|ઓકટોમ્બર", 10),
    ("નવેમ્બર|નવે", 11), ("ડિસેમ્બર|ડિસે", 12),
]
AMOUNT_IN_WORDS = r"([0-9][0-9,]{2,})\s*(?:[-–—*]\s*)?(?:[a-z]{1,4}[,.]?\s*)?\(([A-Za-z][A-Za-z ]{3,90}?)\s+only\)"
STAMP_GUJARATI = r"(?:સ્ટેમ્પ\s*ડ[^\s]{0,8}ટી|સ્ટેમ્પ\s*ડ્યુટી)[^\n]{0,40}?રૂ\.?\s*([0-9][0-9,]*)"
DIRECTIONS = {
    "ઉત્તરે": "North", "દક્ષિણે": "South", "પુર્વે": "East", "પૂર્વે": "East", "પશ્ચિમે": "West", "ઉત્તર": "North",
    "દક્ષિણ": "South", "પુર્વ": "East", "પૂર્વ": "East", "પશ્ચિમ": "West",
}

TITLE_ENGLISH = r"\b(report|agreement|deed|order|judgment|judgement|decree|petition|application|affidavit|sale|purchase|lease|mortgage|power of attorney|will|partition|notice|award|contract|memorandum|resolution|title clearance|sanction letter|allotment|encumbrance)\b"
TITLE_GUJARATI = r"રિપોર્ટ|અરજી|ચુકાનો|દરખાસ્ત|એકરાર|કરાર|હુકમ|દસ્તાવેજ|સોદો|લીઝ|બોન્ડ|પાવરરનામું|કોરમ|નોટિસ"
COMPANY_ENGLISH = r"\b(limited|ltd|pvt|private limited|bank|banking|corporation|corp|company|co|trust|insurance|housing finance|finance|government|govt|municipal|council|authority|board|registrar|sub-registrar|co-operative|cooperative)\b"
COMPANY_GUJARATI = r"લિમિટેડ|બેંક|કંપની|ટ્રસ્ટ|વીમા|સરકાર|નિગમ|મંડળ|સંસ્થા|સહકારી|મ્યુનિસિપલ|ઓથોરિટી"
ROLE_ENGLISH = r"^\s*(the\s+(manager|secretary|branch\s+manager|president|director|chairman|officer)|manager|to)\b"
ROLE_GUJARATI = r"^\s*(પ્રતિ|આદરણીય|શ્રીમાન|મૅનેજર)"
ADDRESSEE = r"^\s*(to\b|પ્રતિ)"
SECTION_LABEL = r":\s*$|[:：]\s*\S"
BODY_VERB = r"\b(says|said|shall|hereby|thereby|herein|is|are|was|were|been|being|have|has|had|will|would|may|must|does|did|agrees|undertakes|covenants|declares|deposed|clause|section|schedule|annexure|exhibit)\b"
SENTENCE_END = r"[.।][\"')\]]?\s*$"
