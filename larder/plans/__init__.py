"""Named compositions: marts, recommendations, diets, reports."""
