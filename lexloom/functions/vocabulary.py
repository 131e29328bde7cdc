"""The spelling dictionary of the question layer."""

# --- Fixed values: terms that questions are corrected towards ---
LEGAL_VOCABULARY = """
amendment amended amending amendments
penalty penalties fine fines punishment punishable
imprisonment contravention compliance offence violation
liability liabilities liable
section subsection provision provisions chapter rule
reference referenced refers cross
substitute substituted substitution
insert inserted insertion
omit omitted modify modified modification
decriminalized revised revision altered alteration
notwithstanding
director directors managing independent nominee
company companies private public foreign government
listed small person
dividend dividends share shares debenture debentures
capital securities member members shareholder
accounts audit auditor auditors
resolution ordinary special
meeting annual extraordinary general
merger amalgamation winding
board committee registrar tribunal
corporate social responsibility
schedule form prescribed
definition definitions meaning
power powers duties duty
appointment removal resignation qualification
prospectus allotment transfer transmission
deposit deposits loan loans borrowing
charge charges registered registration
inspection inquiry investigation
oppression mismanagement
managerial personnel remuneration
valuation valuer
related party transactions
quorum voting proxy ballot
""".split()
# --- end of fixed values ---

LEAST_LENGTH, MOST_EDITS = 4, 2
