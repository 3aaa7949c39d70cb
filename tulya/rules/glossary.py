"""A core of the glossary. A larger one is a parameter (see terms.glossary)."""

#: Source, target, category, preserved, alternatives, aliases.
ENTRIES = [
    ("સર્વોચ્ચ ન્યાયાલય", "Supreme Court", "court", False, [], []),
    ("ઉચ્ચ ન્યાયાલય", "High Court", "court", False, [], ["હાઇ કોર્ટ"]),
    ("જિલ્લા ન્યાયાલય", "District Court", "court", False, [], []),
    ("અદાલત", "Court", "court", False, ["Tribunal", "Forum"], []),
    ("ન્યાયાલય", "Court", "court", False, [], []),
    ("મેજિસ્ટ્રેટ", "Magistrate", "court", False, [], []),
    ("ન્યાયાધીશ", "Judge", "court", False, ["Justice (when elevated)"], []),
    ("લોક અદાલત", "Lok Adalat", "court", True, [], ["લોકઅદાલત"]),
    ("એડવોકેટ", "Advocate", "party", False, [], []),
    ("વકાલતનામું", "Vakalatnama (power of attorney for legal representation)", "party", True, [], ["વકાલતનામા"]),
    ("નોટરી", "Notary", "party", False, [], []),
    ("ફરિયાદ", "FIR (First Information Report)", "police", False, ["complaint (in the general sense)"], []),
    ("પોલીસ", "Police", "police", False, [], []),
    ("જામીન", "Bail", "criminal", False, ["security (in the surety sense)"], []),
    ("વારંટ", "Warrant", "criminal", False, [], ["વારંટી"]),
    ("તપાસ", "Investigation", "criminal", False, ["Inquiry (where a preliminary inquiry is meant)"], []),
    ("ધરાવ", "Seizure", "criminal", False, [], []),
    ("જપ્ત", "Confiscation", "criminal", False, [], []),
    ("આરોપ", "Charge framed", "criminal", False, [], []),
    ("ચાર્જશીટ", "Charge Sheet", "criminal", False, [], ["ચાર્જ શીટ"]),
    ("દંડ", "Punishment", "criminal", False, [], []),
    ("કેદ", "Imprisonment", "criminal", False, ["custody (for pre-trial)"], []),
]
#: Words that alone don't make a phrase.
STOP_WORDS = ["the", "a", "an", "of", "for", "to", "in", "by", "and", "or", "on", "as"]
