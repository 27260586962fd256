"""Named queries over the engine's tables, each with the SQL that states it."""
