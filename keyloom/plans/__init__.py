"""Plans over several tables: join paths, knowledge bases with path rules, task graphs."""
