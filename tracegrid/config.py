"""Fixed values of the symbol alphabet and the default thresholds."""

# The alphabet's special symbols
STRONG, SOFT, FILL, PARAM, CONTROL, MARK, RARE = 251, 249, 91, 63, 195, 210, 61
RARE_SYMBOLS = (63, 95, 195, 210, 249, 251)
CONTROL_SYMBOLS = (195, 249, 63, 210, 61)
# Period candidates that come first
PERIODS = (39, 78, 117)
# Divisors of a length that are taken first
PREFERRED = (78, 39, 117, 26, 13)
PAD_REPORT, PAD_EXPORT = 0.70, 0.85
