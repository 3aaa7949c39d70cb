"""Results depend on each of these being exactly what it is."""

GUJARATI_DIGITS = "૦૧૨૩૪૫૬૭૮૯"
DEVANAGARI_DIGITS = "०१२३४५६७८९"

GUJARATI_MONTHS = {
    "જાન્યુઆરી": 1, "ફેબ્રુઆરી": 2, "માર્ચ": 3, "એપ્રિલ": 4, "એપ્રીલ": 4, "મે": 5, "જૂન": 6, "જુન": 6,
    "જુલાઈ": 7, "જુલાઇ": 7, "ઑગસ્ટ": 8, "ઓગસ્ટ": 8, "સપ્ટેમ્બર": 9, "સપ્ટેંબર": 9, "ઑક્ટોબર": 10,
    "ઓક્ટોબર": 10, "નવેમ્બર": 11, "નવેંબર": 11, "ડિસેમ્બર": 12, "ડિસેંબર": 12,
}
ENGLISH_MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]

#: Script, first and last code point.
SCRIPTS = [
    ("gujarati", 0x0A80, 0x0AFF), ("devanagari", 0x0900, 0x097F), ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF),
]

#: Signs of fonts that put Indic glyphs on other code points: name, pattern of one sign.
LEGACY_SIGNS = [
    ("krutidev", r"[ÚöÆ¼¯ÉÑÚûô\|\uE000-\uF8FF]"),
    ("shusha", r"[ŠŕśŞŗţþ\uF020-\uF0FF]"),
    ("mangal", r"[ØþÏíÄåÇãÁ¼ùê£ðÙ\[ªºíµ¶§¨©]"),
    ("chanakya", r"[ØþÏíÄåÇãÁ¼ùê£ðÙªºíµ¶§¨©]"),
    ("mojibake", r"[ÂÃÄÅÆÇÈÉÊË][\u0080-¿]{1,3}"),
]

#: Taken out of text before it is cut into words; the first range is that wide.
INVISIBLE = r"[\u00AD-\u200F\u202A-\u202E\u2060-\u2064\u2066-\u206F\uFEFF]"
SPACE_SEPARATORS = r"[\t\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000]"

ABBREVIATIONS = [
    "શ્રી.", "સુશ્રી.", "મુ.", "માનનીય", "ડા.", "પ્રો.", "કા.", "ખા.", "તા.", "તારીખ", "રૂ.", "રૂપિયા", "આદિ",
    "નં.", "Rs.", "M/s.", "Pvt.", "Ltd.", "Co.", "Nos.", "Ch.", "Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Sr.",
    "Jr.", "St.", "No.", "vs.", "Sec.", "Art.", "Artl.", "para.", "para", "cl.", "cl", "exb.", "dist.", "i.e.",
    "e.g.", "etc.", "viz.", "pp.", "Ed.",
]

LATIN_OF = {
    "અ": "a", "આ": "aa", "ઇ": "i", "ઈ": "ee", "ઉ": "u", "ઊ": "oo", "એ": "e", "ઐ": "ai", "ઓ": "o", "ઔ": "au",
    "ક": "k", "ખ": "kh", "ગ": "g", "ઘ": "gh", "ઙ": "ng", "ચ": "ch", "છ": "chh", "જ": "j", "ઝ": "jh", "ઞ": "ny",
    "ટ": "t", "ઠ": "th", "ડ": "d", "ઢ": "dh", "ણ": "n", "ત": "t", "થ": "th", "દ": "d", "ધ": "dh", "ન": "n",
    "પ": "p", "ફ": "f", "બ": "b", "ભ": "bh", "મ": "m", "ય": "y", "ર": "r", "લ": "l", "વ": "v", "શ": "sh",
    "ષ": "sh", "સ": "s", "હ": "h", "ળ": "l", "ા": "a", "િ": "i", "ી": "i", "ુ": "u", "ૂ": "u", "ે": "e",
    "ૈ": "ai", "ો": "o", "ૌ": "au", "્": "", "ં": "n",
}

#: Spellings of one sound, folded in this order.
DIGRAPHS = [
    ("ph", "f"), ("sh", "s"), ("chh?", "c"), ("kh", "k"), ("gh", "g"), ("th", "t"), ("j+h", "z"),
    (r"(.)\1+", "$1"), ("aa|ee|ii|oo|uu", ""), ("[^a-z]", ""),
]

#: Gujarati labels as a finding's title spells them, in this order.
TITLE_LABELS = [
    ("ધારા|કલમ", "Section"), ("અનુચ્છેદ", "Article"), ("નિયમન", "Regulation"), ("નિયમ", "Rule"),
    ("પ્રકરણ", "Chapter"), ("અનુસૂચિ", "Schedule"), ("ખંડ", "Clause"), ("અંગ", "Part"), ("વિગત", "Item"),
    (r"રૂપિયા|રૂ\.?", "Rs. "), ("ટકા|ટકે", "%"),
]

FUNCTION_WORDS = [
    "the", "of", "and", "to", "in", "is", "are", "was", "were", "has", "have", "had", "shall", "will", "would",
    "that", "this", "these", "those", "for", "from", "with", "by", "on", "at", "as", "or", "be", "been", "not",
    "any", "all", "which", "said", "such", "under", "before", "after", "between", "into", "their", "his", "her",
    "its", "it", "if", "than", "also", "who", "whom", "there", "when", "where", "a", "an",
]

NO_TRANSLATION = "[No English translation could be produced for this passage - verify against the source page]"
ILLEGIBLE = "[OCR illegible - verify this passage against the source page]"
ILLEGIBLE_SUFFIX = " [illegible OCR removed]"

SEVERITY_WEIGHTS = {"critical": 1.0, "major": 0.5, "minor": 0.2, "info": 0.0}
SEVERITY_RANKS = {"critical": 0, "major": 1, "minor": 2, "info": 3}
SCORE_WEIGHTS = {"datum_integrity": 0.3, "terminology": 0.2, "coverage": 0.15, "semantic": 0.3, "ocr_confidence": 0.05}

DATUM_LABELS = {
    "currency": "Amount", "date": "Date", "time": "Time", "percentage": "Percentage",
    "section_ref": "Legal reference", "case_number": "Case number", "statute": "Statute reference",
    "person_name": "Name", "party_name": "Party name", "place": "Place", "address_pin": "PIN code",
    "count_phrase": "Count", "number": "Number",
}

#: Words that scale a number.
SCALES = {"લાખ": 100_000, "લખ": 100_000, "કરોડ": 10_000_000, "કરોડો": 10_000_000, "અરબ": 1_000_000_000, "સહસ્ર": 1_000}
