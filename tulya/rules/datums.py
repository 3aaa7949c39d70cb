"""Patterns of facts in text with ASCII digits, and what their names mean."""

from .values import ENGLISH_MONTHS, GUJARATI_MONTHS

_D = "[0-9૦-૯]"
_NUMBER = rf"{_D}+(?:,{_D}+)*(?:\.{_D}+)?"
_GU = "|".join(sorted(GUJARATI_MONTHS, key=lambda m: -len(m)))
_EN = "|".join(ENGLISH_MONTHS)
_DATE = "|".join([
    rf"\b{_D}{{4}}[-/.]\s*{_D}{{1,2}}[-/.]\s*{_D}{{1,2}}\b",
    rf"\b{_D}{{1,2}}[-/.]\s*{_D}{{1,2}}[-/.]\s*{_D}{{2,4}}\b",
    rf"\b{_D}{{1,2}}\s*(?:રા|રી|th|st|nd|rd)?\s*(?:{_GU}|{_EN})\s*,?\s*{_D}{{2,4}}\b",
    rf"\b(?:{_GU}|{_EN})\s*{_D}{{1,2}}\s*,?\s*{_D}{{2,4}}\b",
])

#: Kind, severity, pattern, any case; of overlapping matches of one length and place the first kind counts.
PATTERNS = [
    ("currency", "critical", rf"(?:₹|\bRs\.?\s*|\bINR\s*|\bRupees\s+|રૂ(?:પિયા?)?\.?\s*){_NUMBER}", False),
    ("currency", "critical", rf"\b{_D}+(?:,{_D}+)*(?:\.{_D}+)?\s*/-", False),
    ("percentage", "critical", rf"{_D}+(?:[.,]\d+)?\s*(?:%|ટકા|ટકે|percent|per cent)", True),
    ("case_number", "critical", r"\b(?:[A-Z]{1,4}\.?\s*){1,4}(?:No\.?\.?\s*)?[A-Z]?\d+(?:\/\d{2,4})?(?:\s*(?:of|ના|નું)\s*\d{4})?\b", False),
    ("statute", "major", rf"\b(?:{_D}+\s*(?:સે|સા)\s*)?(?:IPC|BNS|CrPC|BNSS|CPC|IEA|BSA|NI\s*Act|NIA|SARFAESI|PMLA|POCSO|NDPS|ULAP|GARB|Act|ધારા|કાયદા)(?:\s*,?\s*19\d{{2}})?\b", False),
    ("section_ref", "critical", rf"(?:Section|Article|Order|Rule|Schedule|Chapter|Part|Clause)\s*(?:{_D}+(?:\s*\(\s*{_D}+\s*\))?(?:\s*\(\s*[a-z]+\s*\))?)|(?:કલમ|ધારા|અનુચ્છેદ|નિયમ|નિયમન|પ્રકરણ|અંગ|અનુસૂચિ|ખંડ|વિગત)\s*(?:{_D}+(?:\s*\(\s*{_D}+\s*\))?(?:\s*\(\s*[a-z]\s*\))?)", False),
    ("date", "critical", _DATE, True),
    ("time", "minor", rf"\b(?:{_D}{{1,2}})\s*[:.]\s*({_D}{{2}})\s*(?:hrs|hour|વાગ્યે|am|pm)?(?:\s*(?:hrs|hours|વાગ્યા))?\b", True),
    ("address_pin", "minor", rf"\b(?:PIN|Pin\.?|પિન|PINCode)\s*[-\s]?\s*({_D}{{6}})\b", False),
    ("number", "major", rf"\b{_NUMBER}\b", False),
]
#: Of these a text has one where a pattern of the kind is found (in lower case for patterns of any case).
NEEDS = {
    "currency": [["₹", "Rs", "INR", "Rupees", "રૂ"], ["/-"]],
    "percentage": [["%", "ટકા", "ટકે", "percent", "per cent"]],
    "statute": [["IPC", "BNS", "CrPC", "CPC", "IEA", "BSA", "NIA", "SARFAESI", "PMLA", "POCSO", "NDPS", "ULAP", "GARB", "Act", "ધારા", "કાયદા"]],
    "section_ref": [[
        "Section", "Article", "Order", "Rule", "Schedule", "Chapter", "Part", "Clause", "કલમ", "ધારા", "અનુચ્છેદ", "નિયમ", "પ્રકરણ", "અંગ",
        "અનુસૂચિ", "ખંડ", "વિગત",
    ]],
    "time": [[":", "."]],
    "address_pin": [["PIN", "Pin", "પિન"]],
}
NAME_NEEDS = {
    "honorific": ["શ્રી", "કુ.", "ડા.", "મુ.", "પ્રો."],
    "latin_honorific": ["Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Shri", "Smt."],
    "role": [
        "વાદી", "આરોપી", "ફરિયાદકર્તા", "હિસ્સેદાર", "જમીનર", "સત્તાવિહી", "પક્ષ", "respondent", "petitioner", "plaintiff", "appellant", "accused",
    ],
    "institution": [
        "લિ", "પ્રાઇવેટ", "ટ્રેડિંગ", "એન્ટરપ્રાઇઝિસ", "સોસાયટી", "બેંક", "ફાઉન્ડેશન", "હોસ્પિટલ", "ટ્રસ્ટ", "એસોસિએશન", "ઇન્સ્ટીટ્યુટ",
        "યુનિવર્સિટી", "કોલેજ", "ન્યાયાલય", "પોલીસ", "કલેક્ટરેટ", "Limited", "Ltd", "Private", "Pvt", "Trading", "Enterprises", "Society",
        "Bank", "Foundation", "Hospital", "Trust", "Association", "Institute", "University", "College", "Court", "Police",
    ],
}
PRIORITY = ["currency", "percentage", "section_ref", "case_number", "statute", "date", "time", "address_pin", "number"]

_W = "(?:[઀-૿A-Za-z][઀-૿A-Za-z.'’-]*)"
HONORIFIC = rf"(?:શ્રી|શ્રીમતી|સુશ્રી|કુ\.|ડા\.|મુ\.|પ્રો\.)\s+({_W}(?:\s+{_W}){{0,3}})"
LATIN_HONORIFIC = r"\b(?:Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.|Shri|Smt\.)\s+((?:[A-Z][a-z'’-]+)(?:\s+(?:[A-Z][a-z'’-]+)){0,3})"
ROLE = rf"(?:પ્રતિવાદી|આરોપી|વાદી|ફરિયાદકર્તા|હિસ્સેદાર|જમીનર|સત્તાવિહી|પ્રથમ\s+પક્ષ|બીજી\s+પક્ષ|respondent|petitioner|plaintiff|appellant|accused)\s*[–—:-]?\s*((?:શ્રી|શ્રીમતી|સુશ્રી)?\s*{_W}(?:\s+{_W}){{0,3}})"
CONNECTORS = [
    "હેઠળ", "હેઠળની", "હેઠળનું", "હેઠળમાં", "તરફ", "તરફની", "વિશે", "વિષે", "દ્વારા", "સાથે", "માટે", "ના", "ની",
    "નું", "માં", "થી", "અને", "તથા", "કે", "વિધે", "સૂચિ",
]
_I = "(?:[઀-૿A-Za-z][઀-૿A-Za-z.&'’-]*)"
INSTITUTION = rf"({_I}(?:\s+{_I}){{0,4}}\s+(?:લિ|લિમિટેડ|લિ\.|પ્રાઇવેટ|ટ્રેડિંગ|એન્ટરપ્રાઇઝિસ|સોસાયટી|બેંક|ફાઉન્ડેશન|હોસ્પિટલ|ટ્રસ્ટ|એસોસિએશન|ઇન્સ્ટીટ્યુટ|યુનિવર્સિટી|કોલેજ|ન્યાયાલય|પોલીસ|કલેક્ટરેટ|Limited|Ltd\.?|Private|Pvt\.?|Trading|Enterprises|Society|Bank|Foundation|Hospital|Trust|Association|Institute|University|College|Court|Police))"
COUNTS = {
    "એક": 1, "બે": 2, "ત્રણ": 3, "ચાર": 4, "પાંચ": 5, "છ": 6, "સાત": 7, "આઠ": 8, "નવ": 9, "દસ": 10, "અગિયાર": 11,
    "બાર": 12, "ત્રર": 13, "ચૌદ": 14, "પંદર": 15, "સોળ": 16, "સત્તર": 17, "અઢાર": 18, "ઉન્નીસ": 19, "વીસ": 20,
    "ત્રીસ": 30, "ચાલીસ": 40, "પચાસ": 50, "સાઠ": 60, "એકસો": 100, "one": 1, "two": 2, "three": 3, "four": 4,
    "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "twenty": 20,
    "thirty": 30, "hundred": 100, "thousand": 1000,
}

#: Institutions and what tells those of one kind apart; the first concept found counts.
CONCEPTS = [
    ("court", ["ન્યાયાલય", "court", "tribunal"]), ("police", ["પોલીસ", "police"]), ("collectorate", ["કલેક્ટરેટ", "collectorate"]),
    ("bank", ["બેંક", "bank"]), ("university", ["યુનિવર્સિટી", "university"]), ("college", ["કોલેજ", "college"]),
    ("hospital", ["હોસ્પિટલ", "hospital"]), ("trust", ["ટ્રસ્ટ", "trust"]),
    ("company", ["લિ.", "લિ", "લિમિટેડ", "પ્રાઇવેટ", "limited", "ltd", "pvt", "private"]),
    ("foundation", ["ફાઉન્ડેશન", "foundation"]),
    ("org", ["સોસાયટી", "એસોસિએશન", "ઇન્સ્ટીટ્યુટ", "society", "association", "institute"]),
]
QUALIFIERS = [
    ("district", ["જિલ્લા", "જિલ્લી", "district"]), ("supreme", ["સુર્વોચ્ચ", "supreme"]), ("high", ["ઉચ્ચ", "high"]),
    ("sub_divisional", ["પરિશ્રમણજિલ્લા", "subdivisional", "sub-divisional"]),
    ("taluka", ["તાલુકા", "taluka", "taluka-level"]), ("village", ["ગામ", "village"]),
]

#: Category of a kind's findings; of any other kind "Data fidelity".
CATEGORIES = {
    "currency": "Amounts", "date": "Dates", "time": "Dates", "section_ref": "Legal references",
    "statute": "Legal references", "case_number": "Legal references", "person_name": "Names", "party_name": "Names",
}
