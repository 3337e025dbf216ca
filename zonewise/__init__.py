"""zonewise: catchment-area assignment on Spark.

Decrees that attach streets and house numbers to schools become normalized
assignment rules; whole batches of addresses are matched to them at once.
"""
