"""GQL text to syntax trees."""
