"""Map algebra, neighbourhoods, reshaping, statistics, vector and visibility operators."""
