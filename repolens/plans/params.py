"""Fixed parameters of the registered queries (constants, never "now")."""

LONG_SINCE = "01/01/1998"        # mm/dd/yyyy, orders-based views
LONG_SINCE_TS = "1998-01-01 00:00:00"
LONG_AS_OF = "2001-09-01"
SHORT_SINCE = "01/15/2024"       # events-based view
SHORT_SINCE_TS = "2024-01-15 00:00:00"
SHORT_AS_OF = "2024-02-01"
TOP_N = 50
K4_AS_OF = "2001-08-02"         # the day after the last order date
